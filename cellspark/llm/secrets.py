"""Secret scan with column functions only: fixed patterns, and two character Markov models.

The models are character bigrams of random strings (values that the patterns find) and of ordinary identifiers (words
elsewhere in the texts), counted over all documents. A long token whose log-likelihood ratio favours the random model
is a span of its own, beside what the patterns find."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import fold
from .names import columns_of, fresh, own

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What every match of ASSIGN with a long value holds: texts without it are not scanned for the pattern.
ASSIGNED = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
#: As `AKIA[A-Z0-9]+` of 18 or more: a shorter run holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: As `[0-9a-f]+` of 16 or more; looking back spares a try at each character of a word.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
VALUE_LENGTH = 12
#: Every match of ACCESS or HEX lies in one of TOKEN.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
VALUE = r"[A-Za-z0-9+/_=.-]+"
IDENTIFIER = r"[A-Za-z_]{6,}"
KINDS = ("assign", "access", "hex", "markov")
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
N = len(CHARACTERS)
#: Share of even chances in the random model, and of the identifiers' single characters in theirs.
EVEN, SINGLE = 0.5, 0.1
#: The most that one pair of characters counts for or against, and the sum that makes a token a secret.
PAIR, RATIO = 3.0, 12.0
#: Matches whose places are added up at once.
AT_ONCE = 64
#: The fold of documents that held_out() measures on.
FOLDS, HELD_OUT = 5, 0
SPANS = "array<struct<start:int,end:int,value:string>>"


def _sums(sizes: Column, start: Column) -> Column:
    """(start, end) of stretches (gap, size) that follow one another from start on."""
    step = lambda done, s: F.struct(
        (done["at"] + s["gap"] + s["size"]).alias("at"), F.array_append(done["all"], F.struct((done["at"] + s["gap"]).alias("start"), (done["at"] + s["gap"] + s["size"]).alias("end"))).alias("all")
    )
    return F.aggregate(sizes, F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all")), step, lambda done: done["all"])


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _where(text: Column, pattern: str, group: int = 0, at_least: int = 0) -> Column:
    """Array of (start, end, value) in code points of the pattern's leftmost matches whose group is long enough.

    Between the matches lie the pieces of split(), so that lengths of both add up to the places: within blocks of
    AT_ONCE matches, and over the blocks."""

    def places(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / AT_ONCE).cast("int")), lambda b: F.slice(sizes, b * AT_ONCE + 1, F.lit(AT_ONCE)))
        whole = lambda block: F.struct(F.lit(0).alias("gap"), F.aggregate(block, F.lit(0), lambda a, s: a + s["gap"] + s["size"]).alias("size"))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, _sums(F.transform(bs, whole), F.lit(0)), lambda block, w: _sums(block, w["start"]))))

    def spans(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
        kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        both = F.zip_with(_let(sizes, places), kept, lambda e, k: F.struct(e["start"].alias("start"), e["end"].alias("end"), k.alias("value")))
        return F.when(F.size(found) > 0, F.filter(both, lambda m: F.length(m["value"]) >= at_least) if at_least else both).otherwise(F.array().cast(SPANS))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _if(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(SPANS))


def _kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))


def patterned(text: Column) -> dict[str, Column]:
    """What the patterns find in a text that is not null: assign, access and hex, each of (start, end, value)."""
    some = text.rlike(TOKEN)
    return {"assign": _if(text.rlike(ASSIGNED), _where(text, ASSIGN, 2, VALUE_LENGTH)), "access": _if(some, _where(text, ACCESS)), "hex": _if(some, _where(text, HEX))}


def found(text: Column) -> Column:
    """What a text holds: assign, access, hex and tokens, each of (start, end, value). Null has nothing."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(*(c.alias(k) for k, c in patterned(text).items()), _if(text.rlike(TOKEN), _where(text, TOKEN)).alias("tokens"))


def samples(docs: DataFrame) -> DataFrame:
    """The labelled samples of all documents: (v, random, n). Random strings are the values that the patterns find, ordinary ones the words elsewhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.when(text.rlike(ASSIGNED), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    bare = F.when(text.rlike(TOKEN), F.regexp_replace(F.regexp_replace(bare, ACCESS, " "), HEX, " ")).otherwise(bare)
    values = F.concat(*(where["value"] for where in patterned(text).values()))
    random = docs.where(text.rlike(ASSIGNED) | text.rlike(TOKEN)).select(F.explode(values).alias("v")).select(F.regexp_extract("v", VALUE, 0).alias("v"), F.lit(True).alias("random"))
    plain = docs.select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("v"), F.lit(False).alias("random"))
    return random.union(plain).where(F.length("v") > 1).groupBy("v", "random").agg(F.count("*").alias("n"))


def trained(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of CHARACTERS, learned from the samples of all documents; 0 where nothing is known.

    What reaches the driver are two tables of N * N counts at most."""
    pairs = _let(F.split("v", ""), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))
    rows = samples(docs).select("random", F.explode(pairs).alias("pair"), "n").groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()
    tables = {k: [[0.0] * N for _ in range(N)] for k in (True, False)}
    for r in rows:
        a, b = CHARACTERS.find(r["pair"][0]), CHARACTERS.find(r["pair"][1])
        if a >= 0 and b >= 0:
            tables[r["random"]][a][b] += r["n"]
    single = [1 + sum(line[b] for line in tables[False]) for b in range(N)]
    single = [x / sum(single) for x in single]
    out = []
    for a in range(N):
        random, plain = (tables[k][a] for k in (True, False))
        for b in range(N):
            p = EVEN / N + (1 - EVEN) * (random[b] / sum(random) if sum(random) else 1 / N)
            q = SINGLE * single[b] + (1 - SINGLE) * (plain[b] / sum(plain) if sum(plain) else single[b])
            out.append(max(-PAIR, min(PAIR, math.log(p / q))))
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Summed log-likelihood ratio of the pairs of a value; positive where it looks random."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    place = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(CHARACTERS), c))
    score = lambda a, b: F.when((a > 0) & (b > 0), F.element_at(table, (a - 1) * N + b)).otherwise(F.lit(0.0))
    step = lambda acc, b: F.struct(b.alias("last"), (acc["sum"] + score(acc["last"], b)).alias("sum"))
    return F.aggregate(place, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def scanned(docs: DataFrame, model: list[float], name: str = "found") -> DataFrame:
    """docs with a column name: assign, access, hex, tokens (start, end, value), base and spans: (start, k, end) of the
    patterns, and of all, k a place in KINDS, in order. Tokens of 16 or more characters whose ratio exceeds RATIO are spans."""
    f = own(name)
    base = F.array_sort(F.concat(_kind(f["assign"], 0), _kind(f["access"], 1), _kind(f["hex"], 2)))
    added = _kind(F.filter(f["tokens"], lambda t: ratio(t["value"], model) > RATIO), 3)
    out = docs.withColumn(name, found(F.col("text"))).withColumn(name, f.withField("base", base).withField("added", added))
    return out.withColumn(name, f.withField("spans", F.array_sort(F.concat(f["base"], f["added"]))))


def _joined(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, a row for each row of docs.

    Null and empty texts have no spans (empty string, hash of the empty string); repeated rows give repeated results;
    other columns are ignored; without samples the ratio is 0 and only the patterns find spans."""
    docs = docs.select("doc_id", "text")
    out = scanned(docs, trained(docs) if model is None else model)
    size = lambda c: F.size(f"found.{c}").cast("long").alias(f"n_{c}")
    return out.select("doc_id", size("assign"), size("access"), size("hex"), F.sha2(_joined(F.col("found.base")), 256).alias("base_sha256"), _joined(F.col("found.spans")).alias("spans"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with mark for each of its spans (start, end), which are in order; those that begin before an earlier one's end share its mark.

    A piece of text goes from the largest end so far to a span's start. Spans are worked through in blocks, about as many
    as a block has spans: the largest end before a span is that before its block or inside it, and a block's pieces are cut
    from the block's part of the text, so that no span walks through the whole text or all other spans."""
    size = F.ceil(F.sqrt(F.size(spans))).cast("int")
    most = lambda ends, k, low: F.greatest(low, F.coalesce(F.array_max(F.slice(ends, F.lit(1), k)), low))

    def cut_out(blocks: Column) -> Column:
        tops = F.transform(blocks, lambda b: F.array_max(b["end"]))
        # the largest end before each block, and at last that of all
        return _let(_let(tops, lambda ts: F.transform(F.sequence(F.lit(0), F.size(ts)), lambda k: most(ts, k, F.lit(0)))), lambda low: F.concat(F.array_join(F.transform(blocks, lambda b, k: one(b, F.get(low, k), F.get(low, k + 1))), ""), F.substring(text, F.element_at(low, -1) + 1, F.length(text))))

    def one(block: Column, low: Column, high: Column) -> Column:
        own = F.substring(text, low + 1, high - low)
        piece = lambda part, s, before: F.when(s["start"] >= before, F.concat(F.substring(part, before - low + 1, s["start"] - before), F.lit(mark))).otherwise(F.lit(""))
        return _let(own, lambda part: F.array_join(F.transform(block, lambda s, i: _let(most(block["end"], i, low), lambda before: piece(part, s, before))), ""))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int")), lambda b: F.slice(spans, b * size + 1, size))
    return _let(blocks, cut_out)


def redacted(docs: DataFrame, model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark (spans that overlap by one), and n_chars brought up to date.

    All rows and all other columns stay as they are, whatever their names; a null text stays null."""
    name = fresh(docs.columns, "found")
    out = scanned(docs, trained(docs.select("text")) if model is None else model, name)
    spans = own(name)["spans"]
    clean = _without(F.col("text"), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), mark)
    some = F.size(spans) > 0
    out = out.withColumn("text", F.when(some, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))


def held_out(docs: DataFrame) -> dict[str, int]:
    """How the models do on documents that they have not seen: tokens of the held-out fold by whether they lie in what
    the patterns find (random) and whether the ratio exceeds RATIO (said); learned from the other folds."""
    part = fold(F.col("doc_id"), FOLDS)
    model = trained(docs.where(part != HELD_OUT).select("text"))
    rows = docs.where(part == HELD_OUT).select(found(F.col("text")).alias("f")).select("f.tokens", F.concat("f.assign", "f.access", "f.hex").alias("base"))
    tokens = rows.select("base", F.explode("tokens").alias("t"))
    random = F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))
    counts = tokens.select(random.alias("random"), (ratio(F.col("t.value"), model) > RATIO).alias("said")).groupBy("random", "said").count().collect()
    out = {"found": 0, "missed": 0, "false": 0, "left": 0}
    for r in counts:
        out[("found" if r["said"] else "missed") if r["random"] else ("false" if r["said"] else "left")] = r["count"]
    return out


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """n_assign, n_access, n_hex, base_sha256 of one text, by the patterns as the contract states them."""
    text, found = text or "", []
    for k, (pattern, group, least) in enumerate(((ASSIGN, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        found.append([(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least])
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(sum(found, [])))
    return len(found[0]), len(found[1]), len(found[2]), hashlib.sha256(joined.encode()).hexdigest()


def brute_spans(text: str | None, model: list[float]) -> str:
    """All spans of one text, by the patterns and by adding up the model's ratios."""
    text, found = text or "", []
    for k, (pattern, group, least) in enumerate(((ASSIGN, 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    for m in re.finditer(TOKEN, text):
        at = [CHARACTERS.index(c) for c in m[0]]
        if sum(round(model[a * N + b], 4) for a, b in zip(at, at[1:], strict=False)) > RATIO:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
