"""Personal data by patterns, and by contexts that the patterns' finds teach.

Base spans come from four fixed patterns with checks (parts of an address, Luhn, digit counts).
They are the seeds. Each occurrence of a seed, and of any other string that looks like an identifier
(has an '@' or digits), has two lexical patterns: the one and the two words before it. Occurrences make
a graph of patterns and instances, which Spark scores in rounds:

* a pattern's confidence for a kind is the sum of its distinct instances' scores over their number
  plus one, whatever their kinds; it needs SUPPORT instances with a score;
* an instance that isn't a seed but has the loose shape of the kind scores 1 - prod(1 - confidence)
  over its patterns of confidence CONFIDENT or more.

Instances that reach ACCEPT are identifiers wherever they occur, and their spans are added. Base spans
always stay. Instances are compared by hash; contexts are read from whole texts. The graph is held in
tables of hashes, counted before they are joined, and cut off by checkpoints after each round.

Null and empty texts have no spans; an empty table gives no rows. Rows repeated with the same doc_id and text
get equal results, each its own row, and a null doc_id is an id like others. There are no ties: every instance that
reaches the threshold counts. Other columns, whatever their names, are not read; redact returns them as they are.
A very long text is searched whole by the task that holds it, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.llm.runtime import apart, checkpointed, map_all, own_name, prepare, small_enough

#: The kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
OTHER = -1
ROUNDS, SUPPORT, CONFIDENT, ACCEPT = 3, 3, 0.5, 0.75
#: Characters before an identifier in which its two words of context are looked for first; as many more as they need.
REACH = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A failed start inside a run of digits fails at each later digit of the run, too, so runs are tried from their first.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[+(]*+[0-9](?:[0-9().+\-/]| (?=[0-9(+]))*+")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses: from each '@' back over the run of local characters, but not into the last address."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)  # a run of local characters never reaches over an '@'
        at = text.find("@", max(done, at + 1))
    return out


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, EMAIL, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), PHONE, m.end()))
        out.sort()
    return out


def _loose_kind(value: str) -> int:
    """The kind that a string resembles without passing its checks."""
    if "@" in value:
        return EMAIL
    digits = sum(c.isdigit() for c in value)
    if value.count(".") >= 3 and re.fullmatch(r"[0-9.]+", value):
        return IP
    if 12 <= digits <= 19 and "(" not in value and "+" not in value:
        return CARD
    return PHONE if 7 <= digits <= 15 else OTHER


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def _context(text: str, start: int) -> tuple[int, int] | None:
    """Hashes of the last word and the last two words before a place; None at a text's beginning."""
    reach = REACH
    while True:
        words = text[max(0, start - reach) : start].rsplit(None, 2)
        if len(words) > 2 or reach >= start:  # the last two are whole
            break
        reach *= 2
    if not words:
        return None
    words = [x.lower() for x in words[-2:]]
    one = _DIGIT.sub("0", words[-1])
    return _hash(one), _hash(f"{words[-2]} {one}") if len(words) > 1 else _hash(f"^ {one}")


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other identifier-like strings with their contexts."""
    out, taken = [], []

    def add(start: int, end: int, kind: int, known: bool) -> None:
        context = _context(text, start)
        if context:
            value = text[start:end].lower() if kind in (EMAIL, OTHER) else _RUN_MARKS.sub("", text[start:end])
            out.append({"start": start, "end": end, "kind": kind, "known": known, "instance": _hash(f"{kind}:{value}"), "one": context[0], "two": context[1]})

    for start, kind, end in base:
        add(start, end, kind, True)
        taken.append((start, end))
    free = [m.span() for m in _RUN.finditer(text)] if _DIGIT.search(text) else []
    at = text.find("@")
    while at >= 0:
        left = at
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        right = _SPACE.search(text, at)
        end = right.start() if right else len(text)
        free.append((left, end))
        at = text.find("@", end)
    taken.sort()
    free.sort()
    k, reach = 0, 0
    for start, end in free:
        while end > start and text[end - 1] in ".,;:()-+/":
            end -= 1
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if start < end and start >= reach:
            add(start, end, _loose_kind(text[start:end]), False)
            reach = end
    return out


_RUN_MARKS = re.compile(r"[^0-9.]")

_SPAN = "struct<start:int,kind:int,end:int>"
_OCCURRENCE = "struct<start:int,end:int,kind:int,known:boolean,instance:long,one:long,two:long>"


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base spans and occurrences of each document."""
    prepare(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("known", pa.bool_()), ("instance", pa.int64()), ("one", pa.int64()), ("two", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                found.append(occurrences(text, base))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(spans, span), pa.array(found, seen)], names=["doc_id", "text_key", "base", "found"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id long, text_key long, base array<{_SPAN}>, found array<{_OCCURRENCE}>")


def accepted_instances(edges: DataFrame) -> DataFrame:
    """(instance, kind) that the rounds accept. edges: distinct pattern, instance, kind, known."""
    scores = None
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    loose = edges.where((~F.col("known")) & (F.col("kind") != OTHER)).withColumn("key", apart("pattern", "kind"))
    for _ in range(ROUNDS):
        seeds = edges.where("known").select("pattern", "kind", F.lit(1.0).alias("score"))
        if scores is not None:
            learnt = edges.where("not known").withColumn("key", apart("instance")).join(scores.select(apart("instance").alias("key"), "score").hint("merge"), "key").select("pattern", "kind", "score")
            seeds = seeds.unionByName(learnt)
        weight = seeds.groupBy("pattern", "kind").agg(F.sum("score").alias("weight"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
        confident = weight.join(total, "pattern").select(apart("pattern", "kind").alias("key"), (F.col("weight") / (F.col("total") + 1)).alias("confidence")).where(F.col("confidence") >= CONFIDENT)
        pulled = loose.join(confident.hint("merge"), "key")
        scores = checkpointed(pulled.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))).alias("score")))
    return scores.where(F.col("score") >= ACCEPT).select("instance", "kind")


def added_spans(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, kind, end) of accepted instances. found: a checkpointed extract()."""
    seen = found.select("doc_id", "text_key", F.explode("found").alias("o")).select("doc_id", "text_key", "o.*")
    patterns = F.explode(F.array(F.col("one"), F.col("two")))
    edges = checkpointed(seen.select(patterns.alias("pattern"), "instance", "kind", "known").distinct())
    accepted = accepted_instances(edges).select(apart("instance", "kind").alias("key"))
    fresh = seen.where("not known").withColumn("key", apart("instance", "kind"))
    return fresh.join(accepted.hint("merge"), "key", "left_semi").select("doc_id", "text_key", "start", "kind", "end").distinct()


def _rendered(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _added(found: DataFrame, doc_id: str, key: str, name: str) -> DataFrame:
    """(doc_id, key, name): the added spans of each document that has any, under the given names."""
    grouped = added_spans(found).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias(name))
    return grouped.withColumnsRenamed({"doc_id": doc_id, "text_key": key})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of the base spans, and all spans."""
    found = checkpointed(extract(docs))
    added = _added(found, "of_id", "of_key", "added")
    joined = found.select("doc_id", "text_key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    every = F.array_sort(F.concat("base", F.coalesce("added", none)))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"), _rendered(every).alias("spans"), F.size(F.coalesce("added", none)).cast("long").alias("n_added"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by the name of its kind; spans that overlap become one, named by the first."""
    merged: list[list[int]] = []
    for start, kind, end in sorted(spans):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    out, at = [], 0
    for start, kind, end in merged:
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with base and added spans of text replaced, and n_chars to match where docs has it."""
    spark = docs.sparkSession
    prepare(spark)
    of_id, of_key, name = (own_name(docs, x) for x in ("_ps_id", "_ps_key", "_ps_added"))
    added = checkpointed(_added(checkpointed(extract(docs)), of_id, of_key, name))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(of_key))
    joined = docs.join(small_enough(added, F.size(name)), here, "left").select(*[docs[f"`{c}`"] for c in docs.columns], name)
    columns = docs.columns
    at_text, at_size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, more in zip(batch.column(at_text).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                if text is not None:
                    spans = base_spans(text) + [(s["start"], s["kind"], s["end"]) for s in more or []]
                    text = redact_text(text, spans) if spans else text
                new.append(text)
            arrays = [batch.column(i) for i in range(len(columns))]
            before = arrays[at_text]
            arrays[at_text] = pa.array(new, pa.string())
            if at_size >= 0:
                sizes = zip(new, before.to_pylist(), arrays[at_size].to_pylist(), strict=True)
                arrays[at_size] = pa.array([n if t == old else len(t) for t, old, n in sizes], batch.schema.field(at_size).type)
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(columns))])

    return map_all(joined, run, docs)
