"""Secrets in texts: three fixed patterns, and character Markov models of random strings against ordinary words.

DataFrame functions only. A span is (start, kind, end) in code points, end exclusive; kind is a place in KINDS.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.arrays import let, running

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run that reaches the least length starts where the run starts, so asking for that length finds the same runs.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_ASSIGN = 6

#: Candidates of the Markov models, their characters, and the least log-likelihood ratio per character pair of a random string.
MIN_CANDIDATE = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RATIO = 1.25
#: At most so many labelled words, of at most so many documents, train the models; three random strings go with each word.
TRAINING_WORDS, TRAINING_DOCS = 20_000, 2_000
SMOOTHING = 0.5

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def _spans(text: Column, pattern: str, kind: int, groups: Column | None = None, least: int = 0) -> Column:
    """All matches of a pattern from left to right; the lengths of matches and of what lies between them give their places.
    groups: of each match the text that must have at least `least` characters."""
    between = F.transform(F.split(text, pattern, -1), F.length)

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.length(m) + b)
        return F.transform(F.arrays_zip(found.alias("m"), running(steps).alias("e")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end")))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if groups is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), groups.alias("g")), lambda x: F.length(x["g"]) >= least), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(_no_spans())


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: assignments to a secret's name, access keys, long hexadecimal runs."""
    assigned = _spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), MIN_ASSIGN)
    return F.concat(assigned, _spans(text, ACCESS_LONG, 1), _spans(text, HEX_LONG, 2))


def labelled_strings(docs: DataFrame, words: int = TRAINING_WORDS, documents: int = TRAINING_DOCS) -> DataFrame:
    """(string, random): ordinary identifiers and random strings.

    Ordinary are the corpus's own runs of candidates' characters, digits included, outside the fixed patterns: those with the
    smallest hashes among the distinct runs of at most so many documents, chosen by hash too (both bounds are parameters, and
    they bound the training at every size). As a corpus may hold few of them, these words are also joined to names, and their
    digests spell numbers, times, order numbers and UUIDs, which are ordinary as well. The same digests spell random strings: in base 64, in
    capitals and digits, in small letters and digits.
    """
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = docs.select(F.col("doc_id").alias("chosen")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    free = F.regexp_replace("text", f"{ASSIGN}|{ACCESS_LONG}|{HEX_LONG}", " ")
    run = F.explode(F.regexp_extract_all(free, F.lit(r"[A-Za-z0-9+/_=-]{5,}"), F.lit(0))).alias("string")
    own = some.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").select(run).distinct().orderBy(F.xxhash64("string"), "string").limit(words)
    digest = F.unhex(F.sha2("string", 256))
    hexed, letters = F.lower(F.hex(digest)), F.translate(F.base64(digest), "+/=", "")
    part = lambda a, n: F.substring(hexed, a, n)
    count = F.conv(part(1, 14), 16, 10)
    time = F.timestamp_seconds(F.conv(part(15, 8), 16, 10).cast("long") % 2_000_000_000)
    numbers = (count, F.concat(count, F.conv(part(23, 6), 16, 10)), F.date_format(time, "yyyyMMddHHmmss"), F.date_format(time, "yyyy-MM-dd-HH-mm-ss"), F.concat(F.lit("978-"), F.substring(count, 1, 1), F.lit("-"), F.substring(count, 2, 4), F.lit("-"), F.substring(count, 6, 4), F.lit("-"), F.substring(count, 10, 1)))
    named = (F.concat_ws("-", F.upper(F.substring("string", 1, 3)), F.date_format(time, "yyyy"), F.substring(count, 1, 8)), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))
    word = F.lower("string")
    joined = (F.concat(word, F.initcap(word)), F.concat_ws("_", word, word), F.concat_ws("/", word, word))
    ordinary = F.explode(F.array("string", *joined, *numbers, *named)).alias("string")
    spelled = F.explode(F.array(F.base64(digest), F.upper(letters), F.lower(letters))).alias("string")
    return own.select(ordinary, F.lit(False).alias("random")).unionByName(own.select(spelled, F.lit(True).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, random over ordinary, smoothed; first character major. The table has
    len(ALPHABET) squared cells; without samples all ratios are 0."""
    n = len(ALPHABET)
    pairs = samples.filter(F.length("string") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.substring(F.col("string"), i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count().collect()
    table = {(r["random"], r["pair"]): r["count"] for r in counts if len(r["pair"]) == 2 and r["pair"][0] in ALPHABET and r["pair"][1] in ALPHABET}
    if not table:
        return [0.0] * (n * n)
    total: dict[tuple[bool, str], int] = {}
    for (kind, pair), c in table.items():
        total[kind, pair[0]] = total.get((kind, pair[0]), 0) + c

    def log_p(kind: bool, a: str, b: str) -> float:
        return math.log((table.get((kind, a + b), 0) + SMOOTHING) / (total.get((kind, a), 0) + SMOOTHING * n))

    return [round(log_p(True, a, b) - log_p(False, a, b), 6) for a in ALPHABET for b in ALPHABET]


def ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ALPHABET's characters: the mean over its pairs, so that length alone decides nothing."""
    table, n = F.lit(model), len(ALPHABET)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))

    def step(acc: Column, i: Column) -> Column:
        here = place(i)
        return F.struct(here.alias("last"), (acc["sum"] + F.coalesce(F.get(table, (acc["last"] - 1) * n + here - 1), F.lit(0.0))).alias("sum"))

    first = F.struct(place(F.lit(1)).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(2), F.length(string)), first, step, lambda acc: acc["sum"] / (F.length(string) - 1))


def random_spans(text: Column, base: Column, model: list[float], least: float = MIN_RATIO) -> Column:
    """What no base span covers of the candidates, where that is long enough and the models call it random."""
    found = _spans(text, CANDIDATE, 3)

    def free(s: Column) -> Column:
        """The candidate's parts between the base spans that touch it: from the k-th end to the next start, both in order."""
        inside = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        begins = F.concat(F.array(s["start"]), F.array_sort(F.transform(inside, lambda b: b["end"])))
        ends = F.concat(F.array_sort(F.transform(inside, lambda b: b["start"])), F.array(s["end"]))
        parts = F.zip_with(begins, ends, lambda a, e: F.struct(a.alias("start"), F.lit(3).alias("kind"), e.alias("end")))
        return F.filter(parts, lambda p: p["end"] - p["start"] >= MIN_CANDIDATE)

    def keep(s: Column) -> Column:
        return ratio(F.substring(text, s["start"] + F.lit(1), s["end"] - s["start"]), model) >= least

    return F.filter(F.flatten(F.transform(found, free)), keep)


def scan_secrets(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """All columns of docs and `base_spans`, `secret_spans` (base and random ones by start, then kind).

    Null and empty texts have no spans. Equal texts have equal spans; an empty table gives an empty one. Own columns that
    clash with the two new ones are replaced. Without a model one is trained on labelled_strings(docs).
    """
    model = train(labelled_strings(docs)) if model is None else model
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("base_spans", base_spans(text))
    both = F.concat(F.col("base_spans"), random_spans(text, F.col("base_spans"), model))
    return found.withColumn("secret_spans", F.sort_array(both)).withColumn("base_spans", F.sort_array("base_spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark; spans are ordered by start."""

    def cut(reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        fresh = F.filter(F.arrays_zip(spans.alias("s"), before.alias("at")), lambda x: x["s"]["start"] >= x["at"])
        pieces = F.transform(fresh, lambda x: F.concat(F.substring(text, x["at"] + F.lit(1), x["s"]["start"] - x["at"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(reach, -1) + F.lit(1), F.length(text)))

    return F.when(F.size(spans) > 0, let(running(F.transform(spans, lambda s: s["end"]), F.greatest), cut)).otherwise(text)
