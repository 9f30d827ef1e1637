"""Column expressions: decoding, cleaning, binning and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- packed records -----------------------------------------------------------

# Record layouts of packed price strings.  Each entry is
# (record width, ((field, offset, length), ...)); "tenths" fields are divided by 10,
# "count" fields are plain integers, keys stay text.
LAYOUTS = {
    "win": (8, (("key", 0, 2), ("tenths", 2, 4), ("count", 6, 2))),
    "place": (12, (("key", 0, 2), ("tenths", 2, 4), ("tenths_max", 6, 4), ("count", 10, 2))),
    "pair": (13, (("key", 0, 4), ("tenths", 4, 6), ("count", 10, 3))),
    "pair10": (10, (("key", 0, 4), ("tenths", 4, 6))),
    "wide": (17, (("key", 0, 4), ("tenths", 4, 5), ("tenths_max", 9, 5), ("count", 14, 3))),
    "trio": (15, (("key", 0, 6), ("tenths", 6, 6), ("count", 12, 3))),
    "trifecta": (17, (("key", 0, 6), ("tenths", 6, 7), ("count", 13, 4))),
}


def unpack(packed, layout: str) -> Column:
    """array<struct> of the records in a packed string; blank and all-zero keys are
    dropped, a price of only 0s or only 9s is NULL."""
    width, fields = LAYOUTS[layout]
    s = _c(packed)

    def record(i: Column) -> Column:
        out = []
        for name, at, size in fields:
            raw = F.trim(F.substring(s, i * width + at + 1, F.lit(size)))
            if name == "key":
                out.append(raw.alias("key"))
                continue
            missing = raw.rlike("^(0*|9+)$") if name.startswith("tenths") else raw == ""
            number = F.when(~missing, raw.try_cast("int"))
            out.append((number / 10.0).alias(name.replace("tenths", "price")) if name.startswith("tenths") else number.alias("pop_rank"))
        return F.struct(*out)

    n = F.floor(F.length(s) / width).cast("int")
    records = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), record))
    return F.filter(records, lambda r: ~r["key"].rlike("^0*$"))


def pad(text, width: int, fill: str = "0") -> Column:
    """Filled on the left up to ``width``; longer texts stay whole (lpad would cut them)."""
    s = _c(text).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, fill)).otherwise(s)


def clock_seconds(packed) -> Column:
    """'MSSt' (minutes, seconds, tenths) to seconds; anything else is NULL."""
    s = pad(F.trim(_c(packed)), 4)
    ok = s.rlike("^[0-9]{4}$")
    m, sec, t = (F.substring(s, a, n).try_cast("int") for a, n in ((1, 1), (2, 2), (4, 1)))
    return F.when(ok, m * 60 + sec + t / 10.0)


def signed(sign, magnitude) -> Column:
    """Sign column times magnitude; unreadable magnitudes count as 0."""
    v = F.coalesce(_c(magnitude).try_cast("int"), F.lit(0))
    return F.when(_c(sign) == "-", -v).otherwise(v)


def join_ordinals(*cols) -> Column:
    """'3-3-2-1' from ordinal columns, blanks and zeros left out."""
    kept = F.filter(F.array(*[F.trim(_c(c).cast("string")) for c in cols]), lambda x: ~x.isin("", "0", "00"))
    return F.concat_ws("-", kept)


def first_ordinal(packed) -> Column:
    return F.split(_c(packed), "-")[0].try_cast("double")


def leading_digits(text) -> Column:
    return F.nullif(F.regexp_extract(_c(text), r"(\d+)", 1), F.lit("")).try_cast("int")


def split_std(packed) -> Column:
    """Population standard deviation of the numbers in a 'a-b-c' string."""
    xs = F.filter(F.transform(F.split(_c(packed), "-"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return array_std(xs, sample=False)


def array_std(xs: Column, sample: bool = True) -> Column:
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    ss = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(ss, n - 1 if sample else n))


def row_std(*cols) -> Column:
    """Sample standard deviation over several columns of one row, NULLs skipped."""
    return array_std(F.filter(F.array(*[_c(c).cast("double") for c in cols]), lambda x: x.isNotNull()))


# --- combinations -------------------------------------------------------------


def combination(selection, ordered: bool, width: int | None = None) -> Column:
    """Canonical text of a selection: '1-2-3', or zero-padded '010203' for ``width``=2."""
    xs = _c(selection) if ordered else F.array_sort(_c(selection))
    if width:
        return F.array_join(F.transform(xs, lambda x: pad(x, width)), "")
    return F.array_join(F.transform(xs, lambda x: x.cast("string")), "-")


def selection(text, width: int | None = None) -> Column:
    """Inverse of ``combination``."""
    s = _c(text)
    if width:
        n = F.floor(F.length(s) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * width + 1, F.lit(width)).try_cast("int"))
    return F.transform(F.split(s, "-"), lambda x: x.try_cast("int"))


# --- time ---------------------------------------------------------------------


def tick_time(year, announced) -> Column:
    """Timestamp from a year and 'MMDDHHMM' text; invalid text is NULL."""
    return F.try_to_timestamp(F.concat(_c(year).cast("string"), _c(announced)), F.lit("yyyyMMddHHmm"))


def tick_time_near(start, announced) -> Column:
    """Year-less tick placed in the year of ``start``, or the year before when that
    would put a December tick after a January start."""
    same = tick_time(F.year(_c(start)), announced)
    return F.when(same > _c(start) + F.expr("interval 180 days"), tick_time(F.year(_c(start)) - 1, announced)).otherwise(same)


def at_clock(day, hhmm) -> Column:
    """Timestamp of 'HHMM' on a date; NULL for longer texts."""
    s = pad(hhmm, 4)
    s = F.when(F.length(s) == 4, s)
    h, m = F.substring(s, 1, 2).try_cast("int"), F.substring(s, 3, 2).try_cast("int")
    return _c(day).cast("timestamp") + F.make_dt_interval(F.lit(0), h, m, F.lit(0))


def age_years(born, day, default: float = -1.0) -> Column:
    return F.coalesce(F.datediff(_c(day), _c(born)) / F.lit(365.25), F.lit(default))


def season(day) -> Column:
    """1 winter (Dec-Feb), 2 spring, 3 summer, 4 autumn."""
    return (F.floor(F.month(_c(day)) % 12 / 3) + 1).cast("int")


# --- numbers ------------------------------------------------------------------


def ratio(a, b, default: float | None = None) -> Column:
    out = F.try_divide(_c(a), _c(b))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(x, lo: float, hi: float) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def unit_floor(x, unit: int = 100) -> Column:
    return (F.floor(_c(x) / unit) * unit).cast("long")


def step_bin(x, width: int) -> Column:
    return (F.floor(_c(x) / width) * width).cast("long")


def cut(x, edges: list[float], labels: list[str], right: bool = True) -> Column:
    """Fixed-edge bin: (lo, hi] when ``right`` else [lo, hi); outside or NULL is NULL."""
    x, out = _c(x), F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def lookup(code, table: dict, default=None) -> Column:
    """Literal dictionary; codes not in it take ``default``."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(_c(code) == F.lit(k), F.lit(v)).otherwise(out)
    return out


def relevance(outcome) -> Column:
    """3, 2, 1 for the first three, else 0."""
    o = _c(outcome)
    return F.when(o.between(1, 3), 4 - o).otherwise(F.lit(0)).cast("int")


def graded_target(outcome) -> Column:
    """1, 1/2, 1/4 for the first three, else 0."""
    o = _c(outcome)
    return F.when(o == 1, 1.0).when(o == 2, 0.5).when(o == 3, 0.25).otherwise(0.0)


# Class edges that results depend on.
DISTANCE_EDGES = [0, 1400, 1800, 2200, 9999]
DISTANCE_LABELS = ["sprint", "mile", "intermediate", "long"]
GAP_LIMITS = {"Rento": 7, "Short": 30, "Medium": 90, "Long": 180}
PRICE_EDGES = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 9999.0]


def distance_category(meters) -> Column:
    return cut(meters, DISTANCE_EDGES, DISTANCE_LABELS)


def gap_category(days) -> Column:
    """Class of the days since the previous start: First | Rento | ... | Rest."""
    d = _c(days)
    out = F.when(d.isNull(), "First")
    for name, limit in GAP_LIMITS.items():
        out = out.when(d <= limit, name)
    return out.otherwise("Rest")
