"""Column functions for manuscripts: sizes, spaces, scripts, page ranges, surnames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of Chinese type sizes and their points, largest first (a unit conversion, no rule).
SIZE_POINTS = {
    "初号": 42.0, "小初号": 36.0, "一号": 26.0, "小一号": 24.0, "二号": 22.0, "小二号": 18.0, "三号": 16.0, "小三号": 15.0,
    "四号": 14.0, "小四号": 12.0, "五号": 10.5, "小五号": 9.0, "六号": 7.5, "小六号": 6.5, "七号": 5.5, "八号": 5.0,
}
# The first character in pinyin order for each initial that starts syllables.
_FIRST_OF_INITIAL = {
    "A": "阿", "B": "芭", "C": "擦", "D": "搭", "E": "蛾", "F": "发", "G": "噶", "H": "哈", "J": "击", "K": "喀", "L": "垃", "M": "妈",
    "N": "拿", "O": "哦", "P": "啪", "Q": "期", "R": "然", "S": "撒", "T": "塌", "W": "挖", "X": "昔", "Y": "压", "Z": "匝",
}
# Surnames whose reading as a name differs from the common one.
SURNAME_INITIALS = {"单": "S", "曾": "Z", "仇": "Q", "解": "X", "区": "O", "查": "Z", "尉迟": "Y", "覃": "Q", "翟": "Z"}


def size_points(name: str) -> float:
    return SIZE_POINTS[name]


def ladder_step(points: Column) -> Column:
    """Place of a size on the ladder of named sizes, 0 for the largest; null for sizes without a name."""
    return reduce(lambda rest, kp: F.when(points == kp[1], F.lit(kp[0])).otherwise(rest), enumerate(SIZE_POINTS.values()), F.lit(None).cast("int"))


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{IsHan}"), F.lit(False))


def hyphenated_range(text: Column) -> Column:
    """Whether a range between digits is written with anything but an em dash."""
    return F.coalesce(text.rlike(r"[0-9]\s*[-–−~～]\s*[0-9]"), F.lit(False))


def with_em_dash(text: Column) -> Column:
    """Ranges between digits with an em dash; applying it again changes nothing."""
    return F.regexp_replace(text, r"(?<=[0-9])\s*[-–−~～]\s*(?=[0-9])", "—")


def surname_initial(surname: Column) -> Column:
    """Latin initial of a surname: overrides, then pinyin collation for Han, else the first letter."""
    zh = F.collate(surname, "zh")
    by_order = reduce(lambda rest, lb: F.when(zh >= F.collate(F.lit(lb[1]), "zh"), F.lit(lb[0])).otherwise(rest), _FIRST_OF_INITIAL.items(), F.lit("A"))
    known = F.coalesce(*[F.when(surname.startswith(s), F.lit(i)) for s, i in sorted(SURNAME_INITIALS.items(), key=lambda x: -len(x[0]))])
    return F.when(has_han(surname), F.coalesce(known, by_order)).otherwise(F.upper(F.substring(F.trim(surname), 1, 1)))


def initial_is_certain(surname: Column) -> Column:
    """False where only an override decides: a break of order there is for a person to judge."""
    return ~reduce(lambda a, s: a | surname.startswith(s), SURNAME_INITIALS, F.lit(False))
