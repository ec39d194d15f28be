"""Personal data: patterned values, and terms that disclose them by what the corpus says about the two together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed
from . import arrays as A
from .blocks import in_small_batches
from .decontaminate import tokens

# The kinds in the order that breaks ties, and their patterns.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match begins within a run of digits whose start has failed, so the run's start is asked for
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: Words on either side of a value that count as its context.
CONTEXT_WORDS = 5
#: Different contexts of one value that a term must be in; copies of a passage count once.
MIN_CONTEXTS = 3
#: Least probability of the value, given that a document has the term.
MIN_POSTERIOR = 0.5
#: Least share of the value's information (its surprise in bits) that the term gives away.
MIN_DISCLOSURE = 0.8


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it and a domain behind it; no run is read twice."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all patterned values, in order. Failing matches are dropped and not tried again."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its values as spaces, so that no word of one is a term."""
    chars = list(text)
    for s, _, e in spans:
        chars[s:e] = " " * (e - s)
    return "".join(chars)


def value_key(lowered: str, span: tuple[int, int, int]) -> str:
    """A value by its kind and what writing it differently leaves alike."""
    s, kind, e = span
    return f"{KINDS[kind]}:" + (lowered[s:e] if kind == 0 else "".join(c for c in lowered[s:e] if c.isdigit() or (kind == 1 and c == ".")))


def contexts(text: str, spans: list[tuple[int, int, int]], width: int) -> list[tuple[str, str, int, int, int]]:
    """(value, term, start, end, context) for the words around each value that are no part of a value."""
    if not spans:
        return []
    lowered = text.translate(_LOWER)
    words = [(m.start(), m.end()) for m in _WORD.finditer(blanked(lowered, spans))]
    starts = np.array([w[0] for w in words], np.int64)
    out = []
    for span in spans:
        value = value_key(lowered, span)
        at = int(np.searchsorted(starts, span[0]))
        near = words[max(0, at - width) : at + width]
        key = hashlib.blake2b(" ".join(lowered[a:b] for a, b in near).encode(), digest_size=8).digest()
        context = int.from_bytes(key, "little", signed=True)
        out += [(value, lowered[a:b], a, b, context) for a, b in near]
    return out


_FOUND = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, held array<string>, "
    "near array<struct<value: string, code: long, context: long>>"
)
#: Bits of a filter of term codes, which is all of a set of terms that tasks are sent; what it lets through too much, the join on the code drops.
FILTER_BITS, _PART_BITS = 26, 15


def values_of(text: str | None, spans: list[tuple[int, int, int]]) -> list[str]:
    """The distinct values of a text."""
    lowered = text.translate(_LOWER) if spans else ""
    return sorted({value_key(lowered, s) for s in spans})


def _scan(docs: DataFrame, width: int) -> DataFrame:
    near_type = pa.list_(pa.struct([("value", pa.string()), ("code", pa.int64()), ("context", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, held, near = [], [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text) if text else []
                for kind in range(4):
                    counts[kind].append(sum(1 for s in spans if s[1] == kind))
                base.append(listed(spans))
                held.append(values_of(text, spans))
                around = contexts(text, spans, width) if spans else []
                code, _ = tokens(pa.array([" ".join(x[1] for x in around)], pa.string()))
                near.append([dict(value=v, code=c, context=k) for (v, _, _, _, k), c in zip(around, code.view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(held, pa.list_(pa.string())), pa.array(near, near_type)],
                names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "held", "near"],
            )

    return in_small_batches(docs).mapInArrow(scan, _FOUND)


def _filter(terms: DataFrame) -> np.ndarray | None:
    """A bit for each value of the low FILTER_BITS of a code that a term has, 8 MB for any number of terms; None without terms."""
    part = F.shiftright("code", _PART_BITS).bitwiseAND((1 << FILTER_BITS - _PART_BITS) - 1)
    place = F.col("code").bitwiseAND((1 << _PART_BITS) - 1)
    rows = terms.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(place).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS - _PART_BITS, 1 << _PART_BITS - 3), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1) if rows else None


def _passing(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (code & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)


def _terms(texts: pa.Array, bits: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words outside of values that the filter lets through: (values of each row, row, code, start, end), in code points."""
    spans, plain = [], []
    for text in texts.to_pylist():
        spans.append(base_spans(text) if text else [])
        plain.append(blanked(text, spans[-1]) if spans[-1] else text)
    raw, borders = A.utf8(pa.array(plain, pa.string()))
    raw = A.lower(raw)
    out = []
    for low, high in A.slices(borders, 1 << 20):
        part, at = raw[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
        start, end, before = A.word_spans(part, at, A.ALNUM)
        code = A.span_hashes(A.byte_codes()[part], start, end)
        some = _passing(code, bits)
        row = np.searchsorted(before, some, "right") - 1
        points = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=points[1:])
        first = points[at[row]]
        out.append((row + low, code[some], points[start[some]] - first, points[end[some]] - first))
    columns = zip(*out) if out else ((), (), (), ())
    return spans, *(A.joined(list(c), kind) for c, kind in zip(columns, (np.int64, np.uint64, np.int64, np.int64)))


def _document_frequency(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(code, n): documents of the whole corpus that have a term of the filter, counted in every task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, row, code, _, _ = _terms(b.column("text"), bits)
            order = np.lexsort((row, code))
            code, row = code[order], row[order]
            new = np.ones(len(code), np.bool_)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            terms, n = np.unique(code[new], return_counts=True)
            yield pa.RecordBatch.from_pydict({"code": terms.view(np.int64), "n": n.astype(np.int64)})

    return in_small_batches(docs).select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


_OCCURRENCES = "doc_id long, text_key long, held array<string>, terms array<struct<code: long, start: long, end: long>>"


def _occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Every place of the filter's terms in all texts, a row per document that has one, with the document's values."""
    place = pa.list_(pa.struct([("code", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, row, code, start, end = _terms(b.column("text"), bits)
            has, low = np.unique(row, return_index=True)
            texts = b.column("text").take(pa.array(has, pa.int64())).to_pylist()
            held = [values_of(t, spans[i]) for i, t in zip(has.tolist(), texts)]
            borders = pa.array(np.append(low, len(row)), pa.int32())
            terms = pa.StructArray.from_arrays([pa.array(code.view(np.int64)), pa.array(start), pa.array(end)], fields=list(place.value_type))
            kept = b.select(["doc_id", "text_key"]).take(pa.array(has, pa.int64()))
            columns = [*kept.columns, pa.array(held, pa.list_(pa.string())), pa.ListArray.from_arrays(borders, terms, type=place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "held", "terms"])

    return in_small_batches(docs).mapInArrow(find, _OCCURRENCES)


def _strong(both: Column, n: Column, prior: Column) -> Column:
    """Whether a term gives a value away, from the documents that have both and those that have the term."""
    posterior = F.least(both / n, F.lit(1.0))
    disclosure = F.log2(posterior / prior) / F.greatest(-F.log2(prior), F.lit(1e-9))
    return (posterior >= MIN_POSTERIOR) & (disclosure >= MIN_DISCLOSURE)


def disclosing_places(found: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(doc_id, text_key, code, start, end): every place, in all documents, of the terms that give some value away.

    A term is in MIN_CONTEXTS different contexts of the value. posterior = documents with both, wherever in them / documents
    with the term. disclosure = the pointwise mutual information of the two, log2(posterior / prior of the value), as a
    share of the value's own information, -log2(prior). None if no term is near enough to a value.
    """
    total = found.count()
    near = found.select(F.explode("near").alias("x")).select("x.*")
    pairs = near.groupBy("value", "code", "context").agg(F.lit(1).alias("_")).groupBy("value", "code").agg(F.count(F.lit(1)).alias("contexts"))
    pairs = checkpointed(pairs.filter(F.col("contexts") >= MIN_CONTEXTS).select("value", "code"))
    bits = _filter(pairs)
    if bits is None:
        return None
    having = found.select(F.explode("held").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("with_value"))
    known = pairs.join(having, "value").join(_document_frequency(docs, bits), "code")
    prior = F.col("with_value") / F.lit(float(total))
    # no more documents have both than have the value: pairs too weak even so go before places are looked for
    known = checkpointed(known.filter(_strong(F.least("with_value", "n"), F.col("n"), prior)))
    bits = _filter(known)
    if bits is None:
        return None
    places = checkpointed(_occurrences(docs, bits))
    codes = F.array_distinct(F.transform("terms", lambda t: t["code"]))
    together = places.select("held", F.explode(codes).alias("code")).select("code", F.explode("held").alias("value"))
    together = together.groupBy("value", "code").agg(F.count(F.lit(1)).alias("both"))
    strong = known.join(together, ["value", "code"]).filter(_strong(F.col("both"), F.col("n"), prior)).select("code").distinct()
    return places.select("doc_id", "text_key", F.explode("terms").alias("t")).select("doc_id", "text_key", "t.*").join(strong, "code")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CONTEXT_WORDS) -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base, spans) for every row.

    ``base`` lists the patterned values as kind:start:end in code points, end exclusive, by start and then kind; ``spans``
    lists them together with every place of a term that discloses a value of any document (kind ``term``). ``width``: words
    on either side of a value among which such terms are sought; their places are all those in the table. ``text_key`` is
    xxhash64 of the text, to bring the spans back to the rows they are of.

    Null and empty texts have no spans. Rows with equal ids keep a row each; equal rows have equal spans. An empty table
    gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    found = checkpointed(_scan(rows, width))
    places = disclosing_places(found, rows)
    if places is None:
        places = found.select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    extra = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("terms"))
    extra = extra.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "terms")
    out = found.drop("near", "held").join(extra, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    kinds = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("long").alias("start"), F.array_position(kinds, F.split(s, ":")[0]).alias("kind"), F.split(s, ":")[2].cast("long").alias("end")
        ),
    )
    terms = F.transform("terms", lambda t: F.struct(t["start"].cast("long").alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("kind"), t["end"].cast("long").alias("end")))
    whole = F.array_sort(F.concat(base, F.coalesce(terms, F.array().cast("array<struct<start: long, kind: long, end: long>>"))))
    text = F.array_join(F.transform(whole, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", text.alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CONTEXT_WORDS) -> DataFrame:
    """The rows with every value generalised to the name of its kind, as <EMAIL>, and every disclosing term removed."""
    spans = find_personal_data(docs, id_col, text_col, width).filter("spans <> ''")
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__doc", "__key"])
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__key"))

    @F.pandas_udf("string")
    def cleaned(texts, spans):
        import pandas as pd

        return pd.Series([redact(t, s) for t, s in zip(texts, spans)], dtype=object)

    clean = cleaned.asNondeterministic()  # else a use of the column runs it again
    kept = docs.join(spans, same, "left")
    changed = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(clean(text_col, "__spans"))
    return kept.withColumn(text_col, changed).select(*docs.columns)


def redact(text: str | None, spans: str | None) -> str | None:
    """Overlapping spans are replaced as one, by the kind of the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>" if kind != TERM else ""]
        at = max(at, end)
    return "".join([*out, text[at:]])
