"""Template residue and error-page text: labelled exemplars found by containment.

A text is cut into passage windows (sentences and lines), and a window into
tokens. Open gaps of any notation become one token, GAP; ids, numbers, addresses
and names become fillers without weight. Windows of the same tokens are one
class: the corpus is cut into tokens once, and everything that follows looks at
classes. Token weights are inverse class frequencies over the whole corpus, so
the copies of a text, however many, do not change what it weighs. They are
counted in a table of SLOTS hash slots (a fixed bound, so it can be broadcast at
any corpus size; slots shared by rare tokens only lower a weight a little).

A class is compared with labelled exemplars through an inverted index. The
containment is the share of the class's weight that the exemplar covers. To
reach the threshold t an exemplar must hold one of the class's heaviest tokens
that together weigh more than 1 - t of it, so looking up only these loses
nothing. Exemplars of letters and forms need a gap, or two words side by side
between which the exemplar has one; filled ones are content. Exemplars labelled
"mention" write about gaps, filler or errors; a class they cover better is no
case.

Defined results: null, empty and blank texts are no cases; repeats of a case
are cases; a null language or source changes nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.llm.exemplars import EXEMPLARS
from goldenloom.session import Scratch, table

SLOTS = 1 << 18
THRESHOLD = 0.62
#: Least weight that an exemplar must cover; keeps single common words from being cases. In a corpus so small that it holds no such weight,
#: RARE of the weight of a word seen nowhere.
MASS, RARE = 5.0, 0.7
#: Weight of the lightest token.
FLOOR = 0.3
#: Windows longer than this many tokens are cut into overlapping parts, so work stays linear in long lines.
SPAN = 64
GAP, FILL, END = "⟨gap⟩", "⟨fill⟩", "⟨end⟩"
#: Greatest weight of a word that no exemplar holds in a window of capitals, where names can't be told from words.
SHOUT = 3.0

# A name in a gap of single brackets has at most six words; doubled brackets hold anything.
_NAME = r"[A-Za-zÀ-ÿ_][A-Za-zÀ-ÿ0-9_]*(?:[ .][A-Za-zÀ-ÿ0-9_]+){0,5}"
_GAPS = re.compile(
    r"\{\{[^{}\n]*\}\}|<%=?[^%\n]*%>|\$\{[^${}\n]*\}|\[\[[^\[\]\n]*\]\]|<<[^<>\n]+>>|«(?! )[^«»\n]+»"
    rf"|##{_NAME}##|@@{_NAME}@@|__{_NAME}?__|\*\|{_NAME}\|\*|%{_NAME}?%|%[sSdD]\b|\$\d\b|\{{[A-Za-zÀ-ÿ0-9_. ]+\}}"
    rf"|\[{_NAME}\]|<{_NAME}>|\([Yy](?:our|OUR) {_NAME} (?:here|HERE)\)|\b(?:NaN|NAN|undefined|UNDEFINED|null|NULL)\b|_{{4,}}"
)
_MAYBE = re.compile(r"[{<\[%$«#@*(]|__|[Nn][aAuU][NlL]|undefined|UNDEFINED")
_HINT = re.compile(r"[@\d]")
_PLAIN = re.compile(r"[\w.+-]+@[\w.-]+|\b[a-z]{4}-\d{6,}|\b[A-Z]{4}-\d{6,}|\d[\d.,:/-]*")
_TOKEN = re.compile(rf"{GAP}|{FILL}|[^\W\d_]+|[,;:!?]|\.(?=\s|$)")
_CUT = re.compile(r"(?<=[.!?。！？])\s+|[\r\n\v\f]+")
#: Leads the tokens of a window of capitals.
LOUD = "!!"


def windows(text: str) -> Iterator[str]:
    for part in _CUT.split(text):
        if part and not part.isspace():
            yield part


def _found(window: str) -> list[str]:
    if _MAYBE.search(window):
        window = _GAPS.sub(f" {GAP} ", window)
    return _TOKEN.findall(_PLAIN.sub(f" {FILL} ", window) if _HINT.search(window) else window)


class Tokens:
    """Tokens of windows; capitalised words inside one that no exemplar holds are fillers."""

    def __init__(self, known: frozenset):
        self.known, self.seen = known, {}

    def __call__(self, window: str) -> list[str]:
        seen, loud, out = self.seen, window.upper() == window, []
        for t in _found(window):
            got = seen.get(t)
            if got is None:
                if len(seen) > 300_000:
                    seen.clear()
                low = t.lower()
                if low[0] == "x" and len(low) > 2 and not low.strip("x"):
                    low = "xx"
                got = seen[t] = (low, t[0].isupper() and low not in self.known)
            out.append(FILL if got[1] and out and not loud else got[0])
        return out

    def classes(self, text: str) -> list[str]:
        """The classes of a text's windows in their order."""
        out = []
        for w in windows(text):
            lead = [LOUD] if w.upper() == w else []
            out += [" ".join(lead + part) for part in spans(self(w)) if part]
        return out


def spans(found: list[str]) -> Iterator[list[str]]:
    if len(found) <= SPAN:
        yield found
    else:
        for i in range(0, len(found) - SPAN // 2, SPAN // 2):
            yield found[i : i + SPAN]


def known_words(exemplars) -> frozenset:
    return frozenset(t.lower() for _, text in exemplars for t in _found(text) if _weighty(t)) | {"xx"}


def slot(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token.encode()) % SLOTS


def _weighty(token: str) -> bool:
    return token != FILL and (token == GAP or token[0].isalpha())


class Index:
    """Exemplars by token, with the token weights of one corpus."""

    def __init__(self, counts, total: int, exemplars=EXEMPLARS, threshold: float = THRESHOLD, mass: float = MASS):
        import math

        self.known = known_words(exemplars)
        tokens = Tokens(self.known)
        self.counts, self.top, self.cut = counts, math.log(total + 2), threshold
        self.mass = min(mass, RARE * self.top)
        self.kinds = [kind for kind, _ in exemplars]
        self.posts: dict[str, list[int]] = defaultdict(list)
        self.pairs: list[frozenset] = []
        for i, (_, text) in enumerate(exemplars):
            found = tokens(text)
            for t in set(found):
                if _weighty(t):
                    self.posts[t].append(i)
            ended = [*found, END]
            self.pairs.append(frozenset((a, c) for a, b, c in zip(ended, ended[1:], ended[2:])
                                         if b == GAP and (c != END or a.isalpha())))
        self.cache: dict[str, float] = {}

    def weight(self, token: str) -> float:
        w = self.cache.get(token)
        if w is None:
            import math

            if len(self.cache) > 200_000:
                self.cache.clear()
            w = max(FLOOR, self.top - math.log(1.0 + self.counts[slot(token)])) if _weighty(token) else 0.0
            self.cache[token] = w
        return w

    def kind(self, found: list[str], shouting: bool = False) -> str | None:
        """Kind of the residue that a window's tokens hold, or None."""
        weights: dict[str, float] = defaultdict(float)
        for t in found:
            if w := self.weight(t):
                weights[t] = min(w, SHOUT) if shouting and t not in self.known else w
        total = sum(weights.values())
        side_by_side = set(zip(found, [*found[1:], END]))
        near: set[int] = set()
        room = total * (1 - self.cut)
        for t, w in sorted(weights.items(), key=lambda x: -x[1]):
            near.update(self.posts.get(t, ()))
            room -= w
            if room < 0:
                break
        if not near:
            return None
        covered: dict[int, float] = defaultdict(float)
        for t, w in weights.items():
            for i in self.posts.get(t, ()):
                if i in near:
                    covered[i] += w
        # A letter's gap left empty shows as two words side by side; it weighs as much as a gap that is seen.
        empty = {i for i in covered if self.kinds[i] == "template" and GAP not in weights and self.pairs[i] & side_by_side}
        extra = self.weight(GAP) if empty else 0.0
        best: dict[str, float] = defaultdict(float)
        for i, c in covered.items():
            kind = self.kinds[i]
            if kind == "template":
                if GAP not in weights and i not in empty:
                    continue
                c += extra
            if c >= self.mass or kind == "mention":
                best[kind] = max(best[kind], c / (total + extra))
        mention = best.pop("mention", 0.0)
        if not best:
            return None
        kind = max(best, key=lambda k: best[k])
        return kind if best[kind] >= self.cut and best[kind] > mention else None


def cut(docs: DataFrame, exemplars) -> DataFrame:
    """(doc_id, at, class) of the windows of every text."""
    import pyarrow as pa

    known = known_words(exemplars)

    def run(batches):
        tokens = Tokens(known)
        for batch in batches:
            ids, at, classes = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens.classes(text) if text else []
                ids += [i] * len(found)
                at += range(len(found))
                classes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(classes, pa.string())], ["doc_id", "at", "class"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, at int, class string")


def count_slots(classes: DataFrame):
    """(classes per token slot, number of classes); the table has SLOTS entries at any size."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        slots: dict[str, int] = {}
        sums, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                n += 1
                for t in set(cell.split(" ")):
                    s = slots.get(t)
                    if s is None:
                        if len(slots) > 500_000:
                            slots.clear()
                        s = slots[t] = slot(t)
                    sums[s] += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(sums[used], n))], ["slot", "n"]
        )

    got = classes.select("class").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.float64)
    here = got[got.slot >= 0]
    counts[here.slot.to_numpy()] = here.n.to_numpy()
    return counts, int(got[got.slot < 0].n.sum())


def classify(docs: DataFrame, threshold: float = THRESHOLD, exemplars=EXEMPLARS) -> DataFrame:
    """doc_id and residue kind of every document that holds residue; the kind is that of the first window which does."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession, "residue")
    held = scratch.save(cut(docs, exemplars), "windows")
    classes = scratch.save(held.select("class").distinct(), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(count_slots(classes))

    def run(batches):
        index = Index(*shared.value, exemplars=exemplars, threshold=threshold)
        for batch in batches:
            kinds = []
            for c in batch.column(0).to_pylist():
                found = c.split(" ")
                loud = found[0] == LOUD
                kinds.append(index.kind(found[1:] if loud else found, loud))
            hit = pa.array([k is not None for k in kinds], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["class", "kind"]).filter(hit)

    hits = classes.mapInArrow(run, "class string, kind string")
    return held.join(hits, "class").groupBy("doc_id").agg(F.min_by("kind", "at").alias("kind"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return classify(table(spark, d, "documents")).select("doc_id")


def kept(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(classify(docs).select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


QUERIES = {"p10_found": found, "p10_kept": kept}
ORACLES: dict[str, str] = {}
