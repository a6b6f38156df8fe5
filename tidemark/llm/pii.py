"""Personal data by bootstrapped contextual extraction.

Fixed patterns find the seed entities; long random-looking words are weak seeds of a fifth kind, ``secret``.  The
words around a seed are its lexical patterns; around every other identifier-shaped word the same patterns
are taken.  Patterns and instances form a bipartite graph, which Spark scores in rounds: a pattern is as reliable
as its instances are known (smoothed by a constant), an instance as likely as one of its reliable patterns is
right.  What a round makes likely counts in the next, so accepted instances vouch for further patterns; the
rounds end when none is accepted any more.  Accepted instances are found identifiers of the pattern's kind, weak
seeds included; their spans join those of the seeds.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_texts, per_row

KINDS, SECRET = ["email", "ip", "card", "phone"], "secret"
# The seed patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run is matched from its start (a match always ends with a whole run), which keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Identifier-shaped: a word with at least four digits or an at sign.
TOKEN = re.compile(r"(?<!\S)\S*[0-9@]\S*")
WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>#*$%&|=`"
#: Random-looking: so many characters, among them as many digits and as many letters.
RANDOM = re.compile(r"(?=(?:[^0-9]*[0-9]){6})(?=(?:[^A-Za-z]*[A-Za-z]){4})[0-9A-Za-z+/=_-]{20,}")
#: Characters before and after a span in which the words of its patterns lie; a word that this cuts is left out.
BEFORE, AFTER = 200, 100
#: Rounds at most, constant of the smoothing, belief in a weak seed, and from which a pattern is reliable and an instance accepted.
ROUNDS, SMOOTH, WEAK, RELIABLE, ACCEPT = 12, 2.0, 0.9, 0.6, 0.75


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, free := m.end()))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the seed entities, by kind and then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: one to three words before it, and the words on both sides."""
    low, high = max(0, start - BEFORE), min(len(text), end + AFTER)
    before, after = WORD.findall(text[low:start].lower()), WORD.findall(text[end:high].lower())
    if low and before and not text[low - 1].isspace() and not text[low].isspace():
        del before[0]
    if high < len(text) and after and not text[high].isspace() and not text[high - 1].isspace():
        del after[-1]
    out = [" ".join([str(n), *before[-n:]]) for n in (1, 2, 3) if len(before) >= n]
    if before and after:
        out.append(f"b {before[-1]} _ {after[0]}")
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Identifier-shaped tokens that no seed touches."""
    if "@" not in text and not DIGIT.search(text):
        return []
    out, spans, k = [], sorted((a, b) for _, a, b in taken), 0
    reach = 0
    for m in TOKEN.finditer(text):
        core = m[0].lstrip(EDGES)
        start = m.end() - len(core)
        core = core.rstrip(EDGES)
        end = start + len(core)
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][1])
            k += 1
        if start >= reach and len(core) >= 5 and ("@" in core or sum("0" <= c <= "9" for c in core) >= 4):
            out.append((start, end))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, text_key string, seeds array<struct<kind:string,start:int,stop:int,instance:string,patterns:array<string>>>, others array<struct<start:int,stop:int,instance:string,weak:boolean,patterns:array<string>>>"


def extract(docs: DataFrame) -> DataFrame:
    """Per row the seeds and the candidates with their contexts; ``text_key`` tells rows of one doc_id apart."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, rest, keys = [], [], []
        for text in as_texts(batch.column(1)):
            found = seeds(text)
            base.append([{"kind": k, "start": a, "stop": b, "instance": text[a:b].lower(), "patterns": contexts(text, a, b)} for k, a, b in found])
            rest.append([{"start": a, "stop": b, "instance": text[a:b].lower(), "weak": bool(RANDOM.fullmatch(text, a, b)), "patterns": contexts(text, a, b)} for a, b in candidates(text, found)])
            keys.append(hashlib.blake2b(text.encode(), digest_size=16).hexdigest() if rest[-1] else "")
        span = [("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string())]
        patterns = ("patterns", pa.list_(pa.string()))
        kinds = [pa.list_(pa.struct([("kind", pa.string()), *span, patterns])), pa.list_(pa.struct([*span, ("weak", pa.bool_()), patterns]))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(base, kinds[0]), pa.array(rest, kinds[1])], names=["doc_id", "text_key", "seeds", "others"])

    return per_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), one, FOUND)


def bootstrap(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS, smooth: float = SMOOTH, reliable: float = RELIABLE, accept: float = ACCEPT) -> DataFrame:
    """``(instance, kind, score)`` of the accepted unseen identifiers.

    ``edges`` holds each pair of pattern and instance once, so a phrase that a third of the rows repeat
    weighs like any other.  Each round writes one table of beliefs; the driver sees a count of it.
    """
    seed = found.select(F.explode("seeds").alias("s")).select("s.kind", F.lit(False).alias("weak"), "s.instance", F.explode_outer("s.patterns").alias("pattern"))
    other = found.select(F.explode("others").alias("s")).select(F.lit(None).cast("string").alias("kind"), "s.weak", "s.instance", F.explode_outer("s.patterns").alias("pattern"))
    edges = scratch.save(seed.unionByName(other).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("weak").alias("weak")))
    start = edges.groupBy("instance").agg(F.max("kind").alias("kind"), F.max("weak").alias("weak"))
    start = scratch.save(start.select("instance", "kind", "weak"))
    known = start.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("belief"))
    weak = start.where("kind is null and weak").select("instance", F.lit(SECRET).alias("kind"), F.lit(WEAK).alias("belief"))
    # A pattern of one instance is never reliable.
    size = edges.where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).where("n > 1")
    graph = scratch.save(edges.select("pattern", "instance").join(size, "pattern"))
    open_ = scratch.save(graph.join(start.where("kind is null").select("instance"), "instance"))
    belief, before, scores = known.unionByName(weak), -1, None
    for _ in range(rounds):
        conf = graph.join(belief, "instance").groupBy("pattern", "kind", "n").agg(F.sum("belief").alias("sure")).select("pattern", "kind", (F.col("sure") / (F.col("n") + smooth)).alias("conf")).where(F.col("conf") >= reliable)
        likely = open_.join(conf, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999999)))))).alias("belief"))
        scores = scratch.save(likely)
        accepted = scores.where(F.col("belief") >= accept).count()
        if accepted == before:
            break
        before = accepted
        belief = known.unionByName(weak.unionByName(scores).groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
    best = scores.groupBy("instance").agg(F.max(F.struct("belief", "kind")).alias("b"))  # of equal scores the kind that comes last by name
    return best.select("instance", "b.kind", F.col("b.belief").alias("score")).where(F.col("score") >= accept)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def find(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """Per row: counts and digest of the seed spans, ``n_found`` further ones, and ``spans`` with all of them.

    A null text is empty, and an empty one holds nothing.  Whole texts are read, whatever their length.  Repeated
    rows are treated alike; a document id shared by different texts is no problem.  An instance that is as
    likely of two kinds gets the one that comes last by name.  Further columns are not read.  An empty table
    gives an empty table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.save(extract(docs))
    accepted = scratch.save(bootstrap(found, scratch, **options))
    more = (
        found.where(F.size("others") > 0).select("doc_id", "text_key", F.explode("others").alias("o")).distinct()
        .join(accepted, F.col("o.instance") == F.col("instance"))
        .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", F.col("o.start").alias("start"), F.col("o.stop").alias("stop"))).alias("more"))
    )
    base = found.select("doc_id", "text_key", F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("base"))
    plain, rich = base.where("text_key = ''").withColumn("more", F.lit(None).cast("array<struct<kind:string,start:int,stop:int>>")), base.where("text_key <> ''")
    both = rich.alias("r").join(more.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.text_key") == F.col("m.text_key")), "left").select("r.doc_id", "r.text_key", "r.base", "m.more")
    rows = plain.unionByName(both)
    rank = {k: i for i, k in enumerate([*KINDS, SECRET])}
    place = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array())), lambda s: F.struct(place[s["kind"]].alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n_of = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *n_of, F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"))
