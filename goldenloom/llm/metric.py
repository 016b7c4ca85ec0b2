"""Exact radius joins of words by partitioning their metric space.

Points are the distinct words of a corpus, the metric is the Levenshtein
distance d. Pivots are the empty word, whose distance to a word is the word's
length, and a word chosen farthest-first from a bounded sample. A point's home
cell is given by its distances to the pivots in rings of RING. If d(x, y) <= r,
the distances of x and y to any pivot differ by r at most (triangle inequality),
so a point near a ring's edge is replicated to the cells that it can reach and
that precede its home cell: every pair meets in exactly one cell, the lesser of
the two home cells. A cell of more than BLOCK points is cut into blocks and its
pairs of blocks are separate groups, so no task grows with a crowded cell.

Two lower bounds of d sort out most pairs inside a cell before the true distance
is computed; neither loses a pair. The distance to the pivot "aaa..." of many
letters is its length less the number of a's in the word, so an edit moves at
most two of all such distances by one: the signature of letter counts differs in
4 bits at most for two edits. An edit touches two neighbouring pairs of letters,
so the signature of letter pairs differs in 8 bits at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8_192
RING = 4
#: Partitions over which the pairs of blocks are spread; their work grows with the square of a block, not with its bytes.
PARTS = 96
#: Words from which the pivot is chosen.
SAMPLE = 2_000
RADIUS = 2
#: Letters from which two words may differ by swaps beside other edits.
SWAPS = 6
#: Words up to this length are compared many at a time, longer ones singly.
WIDE = 64


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded with 0, and their lengths."""
    n = np.array([len(w) for w in words], np.int64)
    wide = int(n.max()) if len(words) else 0
    if not wide:
        return np.zeros((len(words), 0), np.uint32), n
    flat = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), wide), n


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the rows of a to the rows of b, all rows at once."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int16)
    wide, tall = int(lb.max()), int(la.max())
    row = np.broadcast_to(np.arange(wide + 1, dtype=np.int16), (n, wide + 1)).copy()
    out = row[np.arange(n), lb].copy()
    steps = np.arange(wide + 1, dtype=np.int16)
    for i in range(1, tall + 1):
        best = np.empty_like(row)
        best[:, 0] = i
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b[:, :wide] != a[:, i - 1 : i]))
        # Insertions along the row: running minimum of best[j] - j.
        row = np.minimum.accumulate(best - steps, axis=1) + steps
        done = la == i
        out[done] = row[done, lb[done]]
    return out


def within(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances up to RADIUS of the columns of a to those of b, more beyond it: only the diagonals within RADIUS are computed."""
    r, n = RADIUS, a.shape[1]
    far = np.int8(100)
    b = np.concatenate([b, np.zeros((max(len(a) + r + 1 - len(b), 0), n), b.dtype)])
    row = [np.full(n, k - r if k >= r else far, np.int8) for k in range(2 * r + 1)]
    out = np.full(n, far, np.int8)
    off = lb - la + r
    for i in range(len(a) + 1):
        if i:
            new = []
            for k in range(2 * r + 1):
                j = i + k - r
                best = row[k] + (a[i - 1] != b[j - 1]) if j > 0 else np.full(n, far, np.int8)
                if k < 2 * r:
                    best = np.minimum(best, row[k + 1] + np.int8(1))
                if k and j > 0:
                    best = np.minimum(best, new[k - 1] + np.int8(1))
                new.append(np.minimum(best, far))
            row = new
        done = np.flatnonzero(la == i)
        if len(done):
            out[done] = np.stack([x[done] for x in row])[off[done], np.arange(len(done))]
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def from_pivot(words: list[str], pivot: str) -> np.ndarray:
    """Distances of words to one word."""
    out = np.zeros(len(words), np.int32)
    short = [i for i, w in enumerate(words) if len(w) <= WIDE]
    a, la = codes([words[i] for i in short])
    p, lp = codes([pivot])
    out[short] = distances(a, la, np.repeat(p, len(short), 0), np.repeat(lp, len(short)))
    for i, w in enumerate(words):
        if len(w) > WIDE:
            out[i] = distance(w, pivot)
    return out


def choose_pivot(sample: list[str]) -> str:
    """The word farthest from the one that is farthest from the first of the sample."""
    short = [w for w in sample if len(w) <= WIDE]
    if not short:
        return ""
    far = short[int(np.argmax(from_pivot(short, short[0])))]
    return short[int(np.argmax(from_pivot(short, far)))]


def signatures(word: str) -> tuple[int, int]:
    """Bits of letter counts (at least one, at least two) and of neighbouring letters."""
    letters = pairs = 0
    for c in word:
        g = ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 5
        bit = 1 << 2 * g
        letters |= bit << 1 if letters & bit else bit
    for x, y in zip("\0" + word, word + "\0"):
        pairs |= 1 << (ord(x) * 31 + ord(y) * 7) % 63
    return letters, pairs


def swapped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ by two neighbouring letters in each other's place."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    off = a != b
    first = off.argmax(1)
    at, nxt = np.arange(len(a)), np.minimum(first + 1, max(wide - 1, 0))
    return (off.sum(1) == 2) & off[at, nxt] & (a[at, first] == b[at, nxt]) & (a[at, nxt] == b[at, first])


def _pairs_of(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
    """Near pairs of two blocks; ``same`` if they are one block, whose own points then meet once, and once with themselves."""
    right = right.sort_values("size", kind="stable", ignore_index=True)
    x, y = left["word"].to_numpy(object), right["word"].to_numpy(object)
    lx, ly = left["letters"].to_numpy(np.uint64), right["letters"].to_numpy(np.uint64)
    px, py = left["pairs"].to_numpy(np.uint64), right["pairs"].to_numpy(np.uint64)
    sx, sy, own = left["size"].to_numpy(), right["size"].to_numpy(), right["own"].to_numpy(bool)
    starts, ends = np.searchsorted(sy, sx - RADIUS), np.searchsorted(sy, sx + RADIUS, "right")
    ii, jj = [], []
    for i in range(len(x)):
        s, e = starts[i], ends[i]
        j = np.flatnonzero(np.bitwise_count(ly[s:e] ^ lx[i]) <= 2 * RADIUS) + s
        if len(j):
            j = j[np.bitwise_count(py[j] ^ px[i]) <= 4 * RADIUS]
            ii.append(np.full(len(j), i, np.int64))
            jj.append(j)
    ii, jj = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (ii, jj))
    if same:
        keep = ~own[jj] | (x[ii] <= y[jj])
        ii, jj = ii[keep], jj[keep]
    d, one = np.zeros(len(ii), np.int16), np.zeros(len(ii), bool)
    long = np.maximum(sx[ii], sy[jj]) > WIDE
    cx, cy = (codes([w if len(w) <= WIDE else "" for w in ws])[0] for ws in (x, y))
    tx, ty = np.ascontiguousarray(cx.T), np.ascontiguousarray(cy.T)
    plain = np.flatnonzero(~long)
    for at in range(0, len(plain), 100_000):
        k = plain[at : at + 100_000]
        i, j = ii[k], jj[k]
        d[k] = within(tx[: max(sx[i].max(), 1), i], sx[i], ty[:, j], sy[j])
        one[k] = d[k] <= 1
        k = k[(d[k] == 2) & (sx[i] == sy[j])]
        one[k] = swapped(cx[ii[k]], cy[jj[k]])
    for k in np.flatnonzero(long):
        a, b = x[ii[k]], y[jj[k]]
        d[k] = distance(a, b)
        off = [i for i, (p, q) in enumerate(zip(a, b)) if p != q]
        one[k] = d[k] <= 1 or (d[k] == 2 and len(a) == len(b) and len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])
    keep = d <= RADIUS
    a, b = x[ii[keep]], y[jj[keep]]
    first = a <= b
    return pd.DataFrame({"a": np.where(first, a, b), "b": np.where(first, b, a), "distance": d[keep].astype(np.int32), "one": one[keep]})


def near_points(words: DataFrame) -> DataFrame:
    """(a, b, distance, one) of every two distinct ``word`` values within RADIUS edits, a <= b; every word is 0 from itself.

    ``one``: at most one edit if a swap of neighbouring letters counts as one.
    """
    words = words.select("word").where("word <> ''").distinct()
    pivot = choose_pivot([r["word"] for r in words.orderBy(F.xxhash64("word")).limit(SAMPLE).collect()])

    def place(batches):
        for pdf in batches:
            own = pdf["word"].tolist()
            both = [signatures(w) for w in own]
            yield pd.DataFrame({
                "word": own, "size": np.array([len(w) for w in own], np.int32), "far": from_pivot(own, pivot),
                "letters": np.array([a for a, _ in both], np.int64), "pairs": np.array([b for _, b in both], np.int64),
            })

    placed = words.mapInPandas(place, "word string, size int, far int, letters bigint, pairs bigint")

    def ring(c: Column) -> Column:
        return F.floor(c / RING).cast("int")

    steps = (-RADIUS, 0, RADIUS)
    reach = F.array_distinct(F.array(*[F.struct(ring(F.col("size") + i).alias("cx"), ring(F.col("far") + j).alias("cy")) for i in steps for j in steps]))
    home = F.struct(ring(F.col("size")).alias("cx"), ring(F.col("far")).alias("cy"))
    visits = placed.withColumn("home", home).select("*", F.explode(F.filter(reach, lambda c: c <= F.col("home"))).alias("cell"))
    visits = visits.withColumn("own", F.col("cell") == F.col("home")).drop("home", "far")
    sizes = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    visits = visits.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("word", F.lit(3)), F.col("blocks")).cast("int"))
    # Own points of block i meet own points of block j >= i and visitors of any block j.
    last = F.col("blocks") - 1
    left = visits.where("own").select("*", F.lit(True).alias("left"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), last)).alias("j"))
    right = visits.select("*", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("block")).otherwise(last))).alias("i"), F.col("block").alias("j"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf["left"].to_numpy(bool)
        return _pairs_of(pdf[here], pdf[~here], bool(pdf["i"].iloc[0] == pdf["j"].iloc[0]))

    meetings = left.unionByName(right).repartition(PARTS, "cell", "i", "j")
    return meetings.groupBy("cell", "i", "j").applyInPandas(meet, "a string, b string, distance int, one boolean")


def swap_points(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of the distinct ``word`` values of SWAPS letters or more that two swaps of neighbouring letters, or one swap and one
    edit, may part, which are more than RADIUS edits; other pairs near to these come along.

    A word's own forms are the word and what is left without one letter; two words with one edit between them have a form in common.
    """
    words = words.select("word").where(F.length("word") >= SWAPS).distinct()

    def forms(batches):
        for pdf in batches:
            out: set[tuple[str, str, int]] = set()
            for w in pdf["word"]:
                turned = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)} - {w}
                out.update((w, t, 2) for t in turned)
                for kind, own in ((0, {w}), (1, turned)):
                    out.update((w, f, kind) for t in own for f in (t, *(t[:i] + t[i + 1 :] for i in range(len(t)))))
            yield pd.DataFrame(sorted(out), columns=["word", "form", "kind"])

    keyed = words.mapInPandas(forms, "word string, form string, kind int")
    x, y = (keyed.select("form", F.col("word").alias(k), F.col("kind").alias(f"kind_{k}")) for k in "ab")
    met = x.join(y, "form").where("a <> b AND (kind_a = 1 AND kind_b = 0 OR kind_a = 2 AND kind_b = 2)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
