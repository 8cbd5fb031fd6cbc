"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

A prefix filter finds the candidates. All sets are ordered alike, by how many texts hold a shingle and then by the shingle. Two sets
that are near must share a shingle among the first tenth or so of the smaller and the first fifth of the larger. Those are their
rarest shingles: a text with a fifth of its own is paired with nothing, and a passage that many texts share comes last and pairs none of them.
Counts are asked for by groups of texts, of shingles cut to 48 bits, which is enough for an order.

SimHash comes first: of the texts that share such a shingle, those whose fingerprints, of the same shingles, are linked at two bits are each compared
with one of their group, and tied if they are near. The prefix filter is there for the near copies whose fingerprints lie further apart, so none is lost.

Rows that share such a shingle are then tied by stars: in each of a few rounds every shingle's rows are compared with
one of them, the one with the fewest shingles of its own first, and shingles whose rows have become one component are done, so a crowd of near
copies takes a few pairs a row. Rows of what is then left are compared pair by pair unless already tied. Every pair is decided on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import forget, mix, powers
from .components import components
from .exchange import QUESTIONS, REPLIES, questions, read_replies, replies
from .neardup import links as linked_prints
from .words import flat_hashes

WORDS, SHARE = 5, (4, 5)  # similarity as a fraction of whole numbers
BITS, STARS = 48, 10
FEW = 2  # stars end when joining the rest takes so many pairs a row
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of all texts' sets, sorted: the distinct 64-bit hashes of their shingles. A shorter text is one shingle, as is a
    text without a word."""
    (hashes,), n = flat_hashes(texts, lower=True)
    text, start, factor = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n, powers(_STEP, words)
    inside = np.flatnonzero(np.arange(len(text)) - start[text] + words <= n[text])  # where a whole shingle begins
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += hashes[k : len(rolled) + k] * factor[k]
    few = np.flatnonzero(n < words)
    short = np.zeros(len(few), np.uint64)
    for k in range(words - 1):
        some = n[few] > k
        short[some] += hashes[start[few[some]] + k] * factor[k]
    short = np.where(n[few] > 0, mix(short + n[few].astype(np.uint64)), 0).astype(np.uint64)
    grams, owner = np.concatenate((mix(rolled[inside] + np.uint64(words)), short)), np.concatenate((text[inside], few))
    order = np.argsort(grams)
    order = order[np.argsort(_narrow(owner[order]), kind="stable")]
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))) if len(grams) else np.empty(0, bool)
    return owner[new], grams[new]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers in 16 bits, which numpy sorts in linear time."""
    return x.astype(np.uint16) if x.max(initial=0) < 65_536 else x


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of one text."""
    return shingle_sets([text], words)[1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = SHARE
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = shared(a, b)
    return both * down >= (len(a) + len(b) - both) * up


def probed(n: int | np.ndarray) -> int | np.ndarray:
    """How many of n shingles, rarest first, a set is looked up by among smaller ones (for arrays of n as well)."""
    up, down = SHARE
    return n + -(n * up) // down + 1


def indexed(n: int) -> int:
    """How many of n shingles, rarest first, larger sets can find it by."""
    up, down = SHARE
    return n + -(n * 2 * up) // (up + down) + 1


def simhash(grams: np.ndarray) -> int:
    """The fingerprint of a set of shingles, as a signed long: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(grams), bitorder="little").view(np.int64)[0])


def _ask(docs: pd.DataFrame, owners: int) -> pd.DataFrame:
    forget()
    keys, counts = np.unique(shingle_sets(docs["text"].tolist())[1] >> np.uint64(64 - BITS), return_counts=True)
    return questions(int(docs["grp"].iloc[0]), keys, counts, owners, BITS)


def _mark(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The texts with a shingle among their first that other texts may have: those shingles, the whole set, its fingerprint, and how many
    of its shingles no other text has."""
    out = []
    if len(docs):
        owner, grams = shingle_sets(docs["text"].tolist())
        short = grams >> np.uint64(64 - BITS)
        often = read_replies(answers)[np.unique(short, return_inverse=True)[1]]
        size = np.bincount(owner, minlength=len(docs))
        start = np.cumsum(size) - size
        alone = np.bincount(owner[often == 1], minlength=len(docs))
        order = np.argsort(_narrow(np.minimum(often, 65_535)), kind="stable")  # ties, and the most frequent, by shingle
        order = order[np.argsort(_narrow(owner[order]), kind="stable")]
        place = np.arange(len(order)) - start[owner]  # texts keep their stretch of the sorted order
        hit = np.flatnonzero((place < probed(size)[owner]) & (often[order] > 1))
        rows = docs["row"].tolist()
        for some in np.split(hit, np.flatnonzero(np.diff(owner[hit])) + 1) if len(hit) else []:
            i = owner[some[0]]
            whole = grams[start[i] : start[i] + size[i]]
            out.append((rows[i], int(size[i]), grams[order[some]].view(np.int64), place[some], whole.tobytes(), simhash(whole), int(alone[i])))
    return pd.DataFrame(out, columns=["row", "n", "grams", "places", "all", "print", "alone"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [is_near(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (row, all) are near; one set travels a pair, the other once."""
    one, other = sets.select(F.col("row").alias("a"), F.col("all").alias("one")), sets.select(F.col("row").alias("b"), F.col("all").alias("other"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "one", "other").mapInArrow(_verify, "a long, b long")


def simhash_pairs(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): every row (row, print) of a group of linked fingerprints, with the group's smallest row."""
    prints = scratch.save(marked.groupBy("print").agg(F.min("row").alias("least")))
    roots = components(linked_prints(prints, prints.count()), scratch)
    rooted = scratch.save(prints.join(roots, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"), "least"))
    centres = rooted.groupBy("root").agg(F.min("least").alias("b"))
    return marked.select("row", "print").join(rooted.join(centres, "root").select("print", "b"), "print").where("row <> b").select(F.col("row").alias("a"), "b")


def near_links(texts: DataFrame, scratch: Scratch, group_bytes: int = 5_000_000, owner_bytes: int = 8_000_000) -> DataFrame:
    """Links (a, b) between rows of a written table (row, text), enough to connect every two near copies."""
    size, n = texts.agg(F.sum(F.octet_length("text").cast("long") + 1), F.count(F.lit(1))).first()
    size = (size or 0) + n
    groups, owners = max(1, -(-size // group_bytes)), max(1, -(-size // owner_bytes))
    rows = texts.select("row", "text", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"))
    answers = scratch.save(rows.groupBy("grp").applyInPandas(lambda d: _ask(d, owners), QUESTIONS).groupBy("owner").applyInPandas(replies, REPLIES))
    scratch.free()
    marked = scratch.save(rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInPandas(_mark, "row long, n long, grams array<long>, places array<int>, all binary, print long, alone long"))
    scratch.free(answers)
    sets = marked.select("row", "all")
    held = marked.select("row", "n", "alone", F.explode(F.arrays_zip("grams", "places")).alias("g")).select("row", "n", "alone", F.col("g.grams").alias("gram"), F.col("g.places").alias("place"))
    up, down = SHARE
    reach = F.col("n") + F.ceil(-F.col("n") * (2 * up) / (up + down)) + 1  # never below indexed(n)
    several = held.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.max((F.col("place") <= reach).cast("int")).alias("found")).where("rows > 1 AND found = 1")
    held = scratch.save(held.join(several.select("gram"), "gram").withColumn("root", F.col("row")))
    found, links = scratch.save(verified(simhash_pairs(marked.join(held.select("row").distinct(), "row", "left_semi"), scratch), sets)), None
    for turn in range(STARS + 1):
        if not found.isEmpty():
            links = found if links is None else scratch.save(links.unionByName(found))
            roots = components(links, scratch)
            named = held.drop("root").join(roots, F.col("row") == F.col("node"), "left").select("row", "n", "alone", "gram", "place", F.coalesce("root", "row").alias("root"))
            left = named.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("gram")
            before, held = held, scratch.save(named.join(left, "gram"))
            scratch.free(before, shuffles=False)
        sizes = held.groupBy("gram", "root").count().groupBy("gram").agg(F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("count")).alias("tied"))
        rows, pairs_left = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum((F.col("rows") * F.col("rows") - F.col("tied")) / 2), F.lit(0))).first()
        if turn == STARS or pairs_left <= FEW * rows:
            break
        # First the row with the least of its own; later that of some component, so that small ones get their turn.
        first = [F.col("alone")] if turn == 0 else [F.xxhash64("root", F.lit(turn)).alias("h"), F.col("alone")]
        mid = held.groupBy("gram").agg(F.min(F.struct(*first, F.xxhash64("row", F.lit(turn)).alias("g"), "row", "root", "n")).alias("mid"), F.min("root").alias("low"), F.max("root").alias("high"))
        open_ = mid.where("low < high").select("gram", F.col("mid.row").alias("b"), F.col("mid.root").alias("own"), F.col("mid.n").alias("size"))
        pairs = scratch.save(held.join(open_, "gram").where(f"root <> own AND least(n, size) * {down} >= greatest(n, size) * {up}").select(F.col("row").alias("a"), "b").distinct())
        found = scratch.save(verified(pairs, sets))
        scratch.free(pairs, shuffles=False)
    # What is left: the smaller text by a shingle it is indexed by, and the larger; as many shared at most as their places allow.
    small, large = held.where(F.col("place") <= reach), held.select("gram", *[F.col(c).alias(f"{c}2") for c in ("row", "n", "place", "root")])
    able = f"""root <> root2 AND (n < n2 OR n = n2 AND row < row2) AND n * {down} >= n2 * {up}
      AND (least(place, place2) + least(n - place, n2 - place2)) * {up + down} >= (n + n2) * {up}"""
    last = scratch.save(verified(small.join(large, "gram").where(able).select(F.col("row").alias("a"), F.col("row2").alias("b")).distinct(), sets))
    return last if links is None else links.unionByName(last)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id (null last), then the first written.

    Groups are connected by pairs of Jaccard similarity 0.8 or more over five-word shingles, A-Z in lower case. A text of fewer words
    is one shingle; null, empty and blank texts are near copies of one another. Repeated rows, and rows that share an id, are
    decided one by one. An empty table gives no rows. Rows are written once with a number, as it must not change between the decision and the filter.
    """
    scratch = Scratch(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    saved = scratch.save(held.withColumn("row", F.monotonically_increasing_id()))
    roots = components(near_links(saved.select("row", F.col("held")[text].alias("text")), scratch), scratch)
    grouped = scratch.save(saved.select("row", F.col("held")[doc_id].alias("id")).join(roots, F.col("row") == F.col("node")).select("row", "id", "root"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("stays"))
    gone = grouped.join(first, "root").where("row <> stays").select("row")
    return saved.join(gone, "row", "left_anti").select("held.*")
