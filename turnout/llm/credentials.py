"""Secret scans by corpus-wide ownership of candidate values.

Texts are searched for credentials that a name, a known form or a long hex run gives away, and for
bare tokens that could be one. Each value travels as a hash. Over the whole corpus its distinct
repositories and owners are counted: what several owners or many repositories share is a copied
example, what looks random and has one owner is taken for live. Spans with a name or form are always
returned, with that judgement; a bare token becomes a span only if it is judged live, and a short one
only if it is also found with a name or form somewhere.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import stored, text_slices

ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Kinds of spans in the order that breaks ties; bare tokens, long and short, become "live" ones.
KINDS = ["assign", "access", "hex", "live", "live"]
BARE, SHORT = 3, 4
LEAST_ASSIGNED = 6
#: Characters of bare tokens: at least, and from where on a token needs no name elsewhere.
LEAST_BARE, LONG_BARE = 12, 20
#: Different characters of a value that looks random; it also has a letter and a digit.
VARIETY = 8
#: Owners that make a value an example, and repositories that one may have and still be live.
EXAMPLE_OWNERS, LIVE_REPOSITORIES = 3, 10

_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_BARE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b"_-" for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_LETTER, _NUMBER = re.compile(rb"[A-Za-z]"), re.compile(rb"[0-9]")


def looks_live(value: bytes) -> bool:
    return len(set(value)) >= VARIETY and bool(_LETTER.search(value) and _NUMBER.search(value))


def _runs(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Maximal runs of bare characters of each text that are long, or not short and with a digit."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_BARE[joined], prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    wide = stops - starts >= LEAST_BARE
    starts, stops = starts[wide], stops[wide]
    digits = np.concatenate(([0], np.cumsum(_DIGIT[joined])))
    used = (stops - starts >= LONG_BARE) | (digits[stops] > digits[starts])
    starts, stops = starts[used], stops[used]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for doc, a, z in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(),
                         strict=True):
        out[doc].append((a - int(begin[doc]), z - int(begin[doc])))
    return out


def candidates(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, stop, value) in bytes, by start and then kind. Bare tokens touch no other span."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    for a, z in runs:  # both forms are made of bare characters
        for kind, form in ((1, ACCESS), (2, HEX)):
            out += [(kind, a + m.start(), a + m.end(), m[0]) for m in form.finditer(text[a:z])]
    taken = sorted((a, z) for _, a, z, _ in out)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([z for _, z in taken], np.int64)) if taken else starts
    for a, z in runs:
        before = int(np.searchsorted(starts, z))  # spans that begin before the run ends
        if (not before or reach[before - 1] <= a) and looks_live(text[a:z]):
            out.append((BARE if z - a >= LONG_BARE else SHORT, a, z, text[a:z]))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _found(docs: DataFrame) -> DataFrame:
    """Candidates of each row of (row, key, owner, text), in code points, with hashed values."""
    names = ["row", "key", "owner"]
    found = "array<struct<kind:int,start:long,stop:long,value:binary,looks:boolean>>"
    schema = docs.select(*names, F.lit(None).cast("binary").alias("repository"),
                         F.lit(None).cast(found).alias("found")).schema
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
                               ("value", pa.binary()), ("looks", pa.bool_())]))

    def digest(value):
        return hashlib.blake2b(value, digest_size=16).digest()

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                repositories, lists = [], []
                for text, runs in zip(texts, _runs(texts), strict=True):
                    spans = candidates(text, runs)
                    repositories.append(digest(text) if spans else None)
                    if spans and not text.isascii():
                        points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                        spans = [(k, int(points[a]) - 1, int(points[z - 1]), v) for k, a, z, v in spans]
                    lists.append([{"kind": k, "start": a, "stop": z, "value": digest(v), "looks": looks_live(v)}
                                  for k, a, z, v in spans])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(repositories, pa.binary()), pa.array(lists, kind)],
                    [*names, "repository", "found"])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text",
         repository: str | None = None) -> DataFrame:
    """(key, spans) of each row: ``spans`` has start, kind, stop, verdict, owners, repositories, by
    start and then kind; offsets count code points, ``stop`` is exclusive.

    Without a ``repository`` column a document stands for one, and documents with the same text for
    the same. A null owner or repository is one of its own. ``verdict`` is "live" for values that look random and
    have one owner and at most LIVE_REPOSITORIES repositories, "example" for those of EXAMPLE_OWNERS
    owners or more repositories, else "unclear". Null and empty texts have no spans, repeated rows
    stay, an empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
                       F.struct(F.col(owner).cast("string").alias("owner"), *(
                           [F.col(repository).cast("string").alias("repository")] if repository else [])).alias("owner"),
                       F.col(text).cast("string").alias("text"))
    found = stored(_found(rows), "candidates")
    spots = found.select("row", F.struct("owner.owner").alias("owner"),
                         (F.struct("owner.repository") if repository else F.struct("repository")).alias("repository"),
                         F.explode("found").alias("x")).select("row", "owner", "repository", "x.*")
    # combines before each shuffle, so a value in every document is a row for each task
    counts = spots.groupBy("value").agg(F.countDistinct("owner").alias("owners"),
                                        F.countDistinct("repository").alias("repositories"),
                                        F.max(F.col("kind") < BARE).alias("named"))
    spread = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") > LIVE_REPOSITORIES)
    verdict = F.when(spread, "example").when(F.col("looks") & (F.col("owners") == 1), "live").otherwise("unclear")
    kind = F.col("kind")
    judged = spots.join(counts, "value").withColumn("verdict", verdict).where(
        (kind < BARE) | (F.col("verdict") == "live") & ((kind == BARE) | F.col("named")))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.least(kind, F.lit(BARE)).alias("kind"), "stop", "verdict", "owners", "repositories"))).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), names[s["kind"]].alias("kind"), s["stop"].alias("stop"),
        s["verdict"].alias("verdict"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    kinds = "array<struct<start:long,kind:string,stop:long,verdict:string,owners:long,repositories:long>>"
    return found.select("row", "key").join(spans, "row", "left").select(
        F.col("key").alias(key), F.coalesce(named, F.array().cast(kinds)).alias("spans"))


def listed(spans):
    """``spans`` as text: kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
