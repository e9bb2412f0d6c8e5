"""Near-duplicate texts by MinHash bands and Odd sketches.

A text's shingles are hashed to 64 bits. Texts with equal shingle sets form one
class, with the smallest id as its representative; only representatives go on:

1. MinHash samples give band keys; classes that share a band key meet in a bucket.
2. The samples are folded into an Odd sketch, a bitmap of parities. The
   population count of the XOR of two sketches estimates the similarity of a
   pair, most precisely where it is high, and rules out most candidates.
3. What is left is confirmed on the full shingle sets.

Buckets are never expanded into all their pairs. Each member is first compared
with the bucket's leader, the smallest representative; confirmed links are
contracted to components. Buckets that still hold several components are then
searched by blocks: two blocks are compared as a matrix inside a task, which
gives no more links than join its components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.llm.common import arrow_rows
from lexisieve.llm.components import connected
from lexisieve.session import broadcast_if_bounded, materialize

ROWS, BANDS = 6, 36
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
#: Rounds in which members are compared with leaders before what is left is searched by blocks.
LEADER_ROUNDS = 3
#: Classes per block of the search inside a bucket.
BLOCK = 512

#: Bytes that part words.
_PARTS_WORDS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Random numbers by byte and place in a word, for the first places.
_PLACES = 32
_BYTES = _mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * _MIX)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased: a random number for every byte and its place, summed and mixed."""
    data = np.frombuffer(text.encode().translate(_FOLD), np.uint8)
    inside = np.concatenate(([False], ~_PARTS_WORDS[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = lengths.cumsum()
    place = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
    entry = place * 256 + data[inside[1:-1]]
    if lengths.max() > _PLACES:
        values = _mix((entry + 1).astype(np.uint64) * _MIX)
    else:
        values = _BYTES[entry]
    return _mix(np.add.reduceat(values, ends - lengths))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all words as one if there are fewer."""
    hashed = word_hashes(text or "")
    if not len(hashed):
        return hashed
    width = min(width, len(hashed))
    n = len(hashed) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * _MIX + hashed[k:k + n])
    return np.unique(out)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _MIX)
    return (seeds[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


_A, _B = _parameters()


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``SAMPLES`` hash functions over a set that isn't empty."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 256):
        np.minimum(least, (folded[at:at + 256, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = _mix(keys ^ column) * _MIX
    return keys


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of the (sample, value) pairs that fall on each of ``SKETCH_BITS`` bits."""
    place = _mix(least.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8).tobytes()


def most_differing(similarity: float, deviations: float = 5.0) -> int:
    """Differing sketch bits up to which a pair may still be as similar as ``similarity``.

    Of k samples, k(1 - J) differ with standard deviation sqrt(kJ(1 - J)); twice
    as many bits flip, and the expected parity of n bits after m flips is
    n(1 - (1 - 2/n)^m)/2, with variance n/4 at most.
    """
    differing = SAMPLES * (1 - similarity) + deviations * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    expected = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing)) / 2
    return int(expected + 2 * (SKETCH_BITS / 4) ** 0.5)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per text: id, set size, a 128-bit set identity, band keys and sketch."""
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, high, low, keys, sketches = [], [], [], [], []
            for text in frame["text"]:
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                data = shingles.tobytes()
                total = shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(shingles * _MIX + np.uint64(7)))
                high.append(int(total[0]) - (1 << 63))
                low.append(int(total[1]) - (1 << 63) ^ zlib.crc32(data))
                if len(shingles):
                    least = minhashes(shingles)
                    keys.append(band_keys(least).view(np.int64))
                    sketches.append(odd_sketch(least))
                else:
                    keys.append(None)
                    sketches.append(None)
            yield pd.DataFrame({"id": frame["id"], "n": sizes, "high": high, "low": low, "keys": keys, "sketch": sketches})

    return docs.mapInPandas(sign, "id long, n long, high long, low long, keys array<long>, sketch binary")


def _differing() -> F.Column:
    """Differing bits of the binary sketches ``l_sketch`` and ``r_sketch``."""
    part = lambda side, k: F.conv(F.hex(F.substring(f"{side}_sketch", 1 + 4 * k, 4)), 16, 10).cast("long")
    return sum((F.bit_count(part("l", k).bitwiseXOR(part("r", k))) for k in range(SKETCH_BITS // 32)), F.lit(0))


def _with_side(pairs: DataFrame, table: DataFrame, side: str, *columns: str) -> DataFrame:
    return pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (l, r) whose full sets have ``100 * intersection >= percent * union``."""
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, None
        for frame in frames:
            linked = []
            for left, right, r in zip(frame["l_text"], frame["r_text"], frame["r"]):
                if r != last:
                    last, last_set = r, shingle_set(right, width)
                mine = shingle_set(left, width)
                both = len(np.intersect1d(mine, last_set, assume_unique=True))
                linked.append(100 * both >= percent * (len(mine) + len(last_set) - both))
            yield frame.loc[linked, ["l", "r"]]

    members = materialize(pairs.select(F.explode(F.array("l", "r")).alias("id")).distinct())
    used = materialize(texts.join(members, "id", "left_semi").select("id", "text"))
    held = _with_side(_with_side(pairs, used, "l", "text"), used, "r", "text")
    return held.mapInPandas(check, "l long, r long")


def _shingle_sets(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``id`` and the shingle set, as little-endian 64-bit numbers, of the given members."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "shingles": [shingle_set(t, width).tobytes() for t in frame["text"]]})

    # the ids alone are sent to the texts while they are few megabytes, so that not all texts are shuffled
    ids = broadcast_if_bounded(materialize(members.select("id").distinct()))
    return texts.join(ids, "id", "left_semi").mapInPandas(run, "id long, shingles binary").dropDuplicates(["id"])


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups (key, i, j) from frames that are sorted by them."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        names = held[["key", "i", "j"]].to_numpy()
        other = np.flatnonzero((names != names[-1:]).any(axis=1))
        if len(other):
            yield held.iloc[:other[-1] + 1]
            held = held.iloc[other[-1] + 1:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _near_in_groups(frame: pd.DataFrame, limit: int, percent: int) -> np.ndarray:
    """Pairs of rows of one group that the sketches leave, that are in different components, and whose first common
    bucket this is: columns group, differing bits, row, row, sorted. The rows are sorted by group and set size."""
    names = frame[["key", "i", "j"]].to_numpy()
    key, component, n, block = (frame[c].to_numpy() for c in ("key", "component", "n", "block"))
    one_block = names[:, 1] == names[:, 2]
    bits = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
    keys = np.stack(frame["keys"].to_list())
    first = np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1)))
    group = first.cumsum() - 1
    ends = np.append(np.flatnonzero(first)[1:], len(frame))[group]
    found, at, step = [], np.arange(len(frame)), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]
        at = at[100 * n[at] >= percent * n[at + step]]  # sizes go up, so farther rows are too large as well
        if not len(at):
            break
        k = at[(component[at] != component[at + step]) & (one_block[at] | (block[at] != block[at + step]))]
        apart = np.bitwise_count(bits[k] ^ bits[k + step]).sum(axis=1, dtype=np.int64)
        k, apart = k[apart <= limit], apart[apart <= limit]
        shared = keys[k] == keys[k + step]
        here = shared.any(axis=1) & (keys[k, shared.argmax(axis=1)] == key[k])
        found.append(np.stack((group[k], apart, k, k + step), axis=1)[here])
    pairs = np.concatenate([np.zeros((0, 4), np.int64), *found])
    return pairs[np.lexsort(pairs.T[::-1])]


def _cross_links(buckets: DataFrame, marks: DataFrame, texts: DataFrame, width: int, limit: int, percent: int) -> DataFrame:
    """Links between different components of one bucket, enough of them to join what belongs together.

    ``buckets`` has the buckets (key, id, component) that hold several components.
    Members are numbered into blocks by hash; each pair of blocks is one group. Groups lie sorted in their partitions,
    and many small ones are compared at once. Only members of pairs that the sketches leave
    get their full sets, and meet in the same groups again, most similar pairs first;
    pairs that are already joined are passed over, so a group gives fewer links than it has
    rows. A pair is looked at in the first bucket that it shares.
    """
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    placed = (buckets.join(sizes, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .join(marks.select("id", "n", "sketch", "keys"), "id"))
    # a block takes part in the pairs (i, j), i <= j, that hold it
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component",
        "n", "sketch", "keys")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "id")

    def left_over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames):
            yield frame.iloc[np.unique(_near_in_groups(frame, limit, percent)[:, 2:])]

    needed = materialize(grouped(dealt).mapInPandas(left_over, dealt.schema))
    sets = materialize(_shingle_sets(texts, needed, width))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames):
            ids, component, shingles = frame["id"].tolist(), frame["component"].tolist(), frame["shingles"].tolist()
            links, root, last = [], {}, None

            def find(c: int) -> int:
                while root.setdefault(c, c) != c:
                    root[c] = c = root.setdefault(root[c], root[c])
                return c

            for group, _, k, m in _near_in_groups(frame, limit, percent).tolist():
                if group != last:
                    root.clear()
                    last = group
                a, b = find(component[k]), find(component[m])
                if a == b:
                    continue
                x, y = (np.frombuffer(shingles[p], "<u8") for p in (k, m))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    root[a] = b
                    links.append((max(ids[k], ids[m]), min(ids[k], ids[m])))
            yield pd.DataFrame(links, columns=["l", "r"], dtype="int64")

    return grouped(needed.join(sets, "id")).mapInPandas(compare, "l long, r long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    word-shingle sets. A text without words, or null, has an empty set and no
    links; rows that repeat an id count as one document each and carry the same
    component; other columns are ignored; an empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, 1_000):
        signed, classes, component = _grouped(docs, id_col, text_col, width, percent)
    whole = classes.join(component, "id", "left").select(
        "high", "low", "n", F.coalesce("component", "id").alias("component"))
    return signed.select("id", "n", "high", "low").join(whole, ["high", "low", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, their classes, and the components of class representatives with links."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(_signatures(given, width))
    classes = signed.where("n > 0").groupBy("high", "low", "n").agg(F.min("id").alias("id"))
    marks = materialize(signed.join(classes, ["id", "high", "low", "n"], "left_semi").dropDuplicates(["id"]))
    keyed = marks.select("id", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialize(keyed.join(leaders.select("key", "leader"), "key"))
    limit = most_differing(percent / 100)

    def linked(pairs: DataFrame) -> DataFrame:
        """Sketch filter, then full sets."""
        near = _with_side(_with_side(pairs, marks, "l", "n", "sketch"), marks, "r", "n", "sketch")
        near = near.where((100 * F.least("l_n", "r_n") >= percent * F.greatest("l_n", "r_n")) & (_differing() <= limit))
        return materialize(_confirm(materialize(near.select("l", "r")), given, width, percent))

    # a member's commonest leader first; others only where components are still apart, one for each member in a round
    led = materialize(buckets.where("id <> leader").groupBy(F.col("id").alias("l"), F.col("leader").alias("r")).agg(
        F.count(F.lit(1)).alias("shared")))
    links = None
    for _ in range(LEADER_ROUNDS):
        best = led.groupBy("l").agg(F.max_by("r", F.struct("shared", -F.col("r"))).alias("r"))
        found = linked(best)
        links = found if links is None else links.unionByName(found)
        component = connected(links)
        led = materialize(_apart(led.join(best, ["l", "r"], "left_anti"), component).select("l", "r", "shared"))
        if not led.count():
            break
    named = buckets.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    apart = materialize(named.join(mixed.select("key"), "key", "left_semi"))
    component = connected(links.unionByName(_cross_links(apart, marks, given, width, limit, percent)))
    return signed, classes, component


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (l, r) whose ends are in different components."""
    for side in ("l", "r"):
        pairs = pairs.join(component.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component")), side, "left")
    return pairs.where(F.coalesce("l_component", "l") != F.coalesce("r_component", "r"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with their columns.

    Of rows that repeat an id all stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
