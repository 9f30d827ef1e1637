"""Personal data: patterns for emails, addresses, cards and phones, and a trained tagger for what they miss.

The patterns' spans always stay.  The tagger (tagger.py) is trained in each run on windows of a bounded sample of the
documents: what the patterns find there is labelled, and made-up items in many spellings (also such that no pattern
knows, and look-alikes that are none) are set in.  Its spans are added where they pass the checks of their kind and
don't touch a pattern's span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import tagger
from .common import pieces
from .tagger import KINDS, WINDOW

#: Documents of which a window is labelled for training.
SAMPLE = 1500
#: Windows the tagger is trained on.
EXAMPLES = 3000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits that fails does so from any of them
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, in the order of start and kind."""
    if not _SIGN.search(text):
        return []
    out = []
    end, at = 0, text.find("@")
    while at >= 0:  # from each sign to the left, so that a long text without signs costs nothing
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, 0, end))
        else:
            end = max(end, at + 1)  # no match goes through a sign
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


_GROUPED = re.compile(r"\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,5}([\x20./-][0-9]{2,5})*")


def accepted(kind: int, text: str, start: int, end: int) -> bool:
    """Whether the tagger's span may be added: it stands by itself and looks like its kind, and so holds a digit or an @."""
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    s = text[start:end]
    digits = digits_of(s)
    if KINDS[kind] == "email":
        return "@" in s[1:-1] and len(s) >= 5
    if KINDS[kind] == "ip":
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(_GROUPED.fullmatch(s))


def all_spans(model, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, from a pattern) of every whole text."""
    base = [base_spans(t) for t in texts]
    some = [k for k, t in enumerate(texts) if _SIGN.search(t)]
    out = [[(*s, True) for s in own] for own in base]
    for k, found in zip(some, tagger.find(model, [texts[k] for k in some], _SIGN)):
        new = [(a, kind, b, False) for kind, a, b in found if accepted(kind, texts[k], a, b) and all(b <= s or e <= a for s, _, e in base[k])]
        if new:
            out[k] = sorted(out[k] + new)
    return out


# --- training examples -----------------------------------------------------------------------------------------------


def _item(rng: np.random.Generator) -> tuple[int, str]:
    """A made-up item and its kind; -1 for what only looks like one."""
    def word(n):
        return "".join(rng.choice(list("abcdefghiklmnoprstuvw"), n))

    def number(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    pick = rng.integers(0, 10)
    if pick < 2:
        name = word(rng.integers(2, 9)) + rng.choice(["", ".", "_"]) + rng.choice(["", number(2)])
        return 0, name + rng.choice(["@", " @ "], p=[0.85, 0.15]) + word(rng.integers(3, 8)) + rng.choice([".com", ".org", number(1) + ".example.com", " . net"], p=[0.3, 0.3, 0.3, 0.1])
    if pick < 4:
        return 1, rng.choice([".", "-", ":"], p=[0.8, 0.1, 0.1]).join(str(n) for n in rng.integers(1, 255, 4))
    if pick < 6:
        body = str(rng.integers(3, 7)) + number(14)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return 2, rng.choice(["", " ", "-", "."]).join(body[i : i + 4] for i in range(0, 16, 4))
    if pick < 8:
        a, b, c = str(rng.integers(2, 10)) + number(2), number(3), number(4)
        return 3, rng.choice([f"+1 ({a}) {b}-{c}", f"+{a[:2]} {b} {c} {a[1:]}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{a[:2]} {b} {c}"])
    return -1, rng.choice([number(rng.integers(1, 7)), f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", "AKIA" + word(8).upper() + number(4), "token=" + "".join(rng.choice(list("0123456789abcdef"), 24)), "@" + word(6), f"{rng.integers(1, 99)},{number(3)}"])


def examples(texts: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with their labels; into three of four an item is set."""
    rng = np.random.default_rng(seed)
    code, tags = np.full((count, WINDOW), 10, np.int64), np.zeros((count, WINDOW), np.int64)
    for k in range(count):
        text = texts[rng.integers(0, len(texts))]
        a = int(rng.integers(0, max(1, len(text) - WINDOW)))
        text = text[a : a + WINDOW]
        spans = [(s, kind, e) for s, kind, e in base_spans(text)]
        if rng.random() < 0.75:
            kind, item = _item(rng)
            at = int(rng.integers(0, max(1, len(text) - len(item))))
            at = text.find(" ", at) + 1 or at
            text = (text[:at] + item + " " + text[at:])[:WINDOW]
            spans = [(at, kind, min(at + len(item), WINDOW))] if kind >= 0 else []
            spans += [s for s in base_spans(text) if all(s[2] <= x or y <= s[0] for x, _, y in spans)]
        code[k, : len(text)] = tagger.codes(text)
        for s, kind, e in spans:
            if s < min(e, WINDOW):
                tags[k, s:e] = 2 * kind + 2
                tags[k, s] = 2 * kind + 1
    return code, tags


def fit(docs: DataFrame, sample: int = SAMPLE, count: int = EXAMPLES, seed: int = 5, key: str = "doc_id", text: str = "text"):
    """Trains the tagger on windows of at most ``sample`` documents, those with the smallest hashes, each at a place that
    the hash gives.  Without any text it is trained on the made-up items alone."""
    h = F.xxhash64(F.col(key), F.length(text))
    place = F.pmod(h, F.greatest(F.length(text) - 200, F.lit(1))).cast("int") + 1
    rows = docs.filter(F.length(text) > 0).select(h.alias("h"), F.substring(F.col(text), place, F.lit(200)).alias("part"))
    texts = [r["part"] for r in rows.orderBy("h", "part").limit(sample).collect() if r["part"]]
    return tagger.train(*examples(texts or [" " * WINDOW], count, seed), seed=seed)


# --- over documents --------------------------------------------------------------------------------------------------

SPANS = "array<struct<start:int,kind:string,end:int,base:boolean>>"


def _over(model, keep: list[str], redacted: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        p = model.value
        for batch in pieces(batches, "__text"):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
            found = all_spans(p, texts)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            if redacted:
                new = pa.array([mask(t, s) if s else t for t, s in zip(texts, found)], pa.string())
                nulls = batch.column(batch.schema.get_field_index("__text")).is_null()
                columns.append(new.take(pa.array([None if n else i for i, n in enumerate(nulls.to_pylist())], pa.int64())))
            else:
                columns.append(pa.array([[{"start": a, "kind": KINDS[k], "end": b, "base": x} for a, k, b, x in own] for own in found], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))))
            yield pa.record_batch(columns, names=[*keep, "__out"])

    return run


def mask(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Puts <kind> in the place of every span; spans that overlap become one, named by the first."""
    out, at, upto = [], 0, -1
    for a, kind, b, _ in spans:
        if a >= upto:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = upto = max(upto, b)
    return "".join(out) + text[at:]



def find_spans(docs: DataFrame, model=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (start, kind, end in code points, base: from a pattern) of every row's whole text.

    Null and empty texts have no spans.  Repeated rows have equal spans; a null key is a key like any other.  Empty
    table: no rows.  One pass without a shuffle; the model (a few kB) is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs, key=key, text=text))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(_over(model, ["doc_id"], False), f"doc_id long, __out {SPANS}").withColumnRenamed("__out", "spans")


def redact(docs: DataFrame, model=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by <kind>.  Null texts stay null; other columns pass."""
    from pyspark.sql import types as T

    model = docs.sparkSession.sparkContext.broadcast(model or fit(docs, key=key, text=text))
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("__out", T.StringType())])
    out = docs.withColumnRenamed(text, "__text").mapInArrow(_over(model, others, True), schema)
    return out.withColumnRenamed("__out", text).select(docs.columns)
