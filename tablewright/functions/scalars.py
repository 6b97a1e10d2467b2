"""Scalar functions of the file dialect as column expressions; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Date layouts that inference knows, as Spark patterns.
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy.MM.dd", "dd-MMM-yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "yyyyMMdd")
#: Comments by what a column name holds, the first that fits.
COMMENTS = (
    ("ends", ("id",), "标识符"),
    ("holds", ("name", "title"), "名称"),
    ("holds", ("time", "date"), "时间"),
    ("holds", ("amount", "price", "total"), "金额/数量"),
    ("holds", ("status", "state"), "状态"),
    ("holds", ("flag", "is_"), "标志位"),
    ("holds", ("email",), "电子邮箱"),
    ("holds", ("phone", "mobile"), "电话号码"),
    ("matches", (r"(^ip_|_ip$|_ip_|^ip$)",), "IP 地址"),
    ("holds", ("url",), "URL"),
    ("holds", ("img", "image", "avatar"), "图片 URL"),
    ("holds", ("description", "desc"), "描述"),
    ("holds", ("key",), "键"),
    ("holds", ("type",), "类型"),
)


def to_number(c: Column) -> Column:
    """Text as a double, null where it isn't a plain number; type letters (``1d``) don't count as one."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_integer(c: Column) -> Column:
    """Text as a long, null unless it is all digits with a sign at most."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def plus(a: Column, b: Column) -> Column:
    """The sum of two numbers, or else the two texts in a row."""
    x, y = to_number(a), to_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), (x + y).cast("string")).otherwise(F.concat(a.cast("string"), b.cast("string")))


def truthy(c: Column) -> Column:
    """Blank, false, no, off and 0 are false; other text and numbers are true."""
    text = F.lower(F.trim(c.cast("string")))
    number = to_number(text)
    return F.when(text.isNull() | text.isin("", "false", "no", "off"), False).when(number.isNotNull(), number != 0).otherwise(True)


def round_scaled(c: Column, digits: int = 0) -> Column:
    """Rounds half away from zero after scaling by a power of ten."""
    scale = F.lit(10.0**digits)
    return F.round(c.cast("double") * scale) / scale


def like(c: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return c.ilike(pattern)


def sanitize(c: Column) -> Column:
    """Text without terminal escape sequences and control characters."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), "\x1b\\[[0-9;?]*[ -/]*[@-~]", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def is_date(c: Column) -> Column:
    """Whether text reads as a date in one of the known layouts."""
    text = F.trim(c.cast("string"))
    shapes = r"^(\d{4}-\d\d-\d\d([ T]\d\d:\d\d:\d\d)?|\d{4}/\d\d/\d\d( \d\d:\d\d:\d\d)?|\d\d/\d\d/\d{4}( \d\d:\d\d:\d\d)?|\d{4}\.\d\d\.\d\d|\d\d-[A-Z][a-z]{2}-\d{4}|[A-Z][a-z]{2,8} \d\d, \d{4}|\d{8})$"
    read = F.coalesce(*(F.try_to_timestamp(F.when(text.rlike(shapes), text), F.lit(p)) for p in DATE_LAYOUTS))
    return text.rlike(shapes) & read.isNotNull()


def inferred_type(c: Column) -> Column:
    """An aggregate: INTEGER, FLOAT, DATE or TEXT, the first that all samples fit; blanks and NULL texts are skipped.

    No samples at all give TEXT, blank ones alone INTEGER.
    """
    text = F.trim(c.cast("string"))
    blank = text.isNull() | text.isin("", "NULL", "null")
    every = lambda test: F.coalesce(F.bool_and(F.when(~blank, F.coalesce(test, F.lit(False)))), F.lit(True))
    return F.when(F.count(F.lit(1)) == 0, "TEXT").when(every(to_integer(text).isNotNull()), "INTEGER").when(every(to_number(text).isNotNull()), "FLOAT").when(every(is_date(text)), "DATE").otherwise("TEXT")


def inferred_comment(name: Column, kind: Column, sample: Column) -> Column:
    """A comment from a column's name, type and a sample value."""
    low = F.lower(name)
    out = None
    for how, parts, comment in COMMENTS:
        tests = [low.endswith(p) if how == "ends" else low.rlike(p) if how == "matches" else low.contains(p) for p in parts]
        test = tests[0]
        for t in tests[1:]:
            test = test | t
        out = F.when(test, comment) if out is None else out.when(test, comment)
    out = out.when(low.contains("json") | kind.contains("json"), "JSON 数据")
    long = F.concat(F.lit("示例: "), F.substring(sample, 1, 20), F.lit("..."))
    return out.when(F.length(sample) > 20, long).when(F.coalesce(sample, F.lit("")) != "", F.concat(F.lit("示例: "), sample)).otherwise("")


def key_family(c: Column) -> Column:
    """A key with its UUIDs, hexadecimal runs and numbers replaced by placeholders."""
    uuid = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, uuid, "{uuid}"), "[0-9a-fA-F]{8,}", "{hex}"), r"\d{2,}", "{id}")


def value_type(c: Column) -> Column:
    """integer, float, json or string."""
    return F.when(c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull(), "integer").when(c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), "float").when(F.ltrim(c).rlike(r"^[\{\[]"), "json").otherwise("string")
