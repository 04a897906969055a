"""Evaluation passages inside corpus documents, by a generalised suffix automaton.

The automaton is built over the words of the test items, so that one state stands for all places at
which a word sequence occurs. A document's words run through it once: every position gets the length
of the longest match that ends there. Maximal matches of at least `seed` words are laid on the item's
diagonal and joined over changed words; a passage is a leak if at least `least` words long and if
`density` of its words agree (three of twenty may be changed). Lead-ins, which are openings that `shared` or
more different item texts have in common, are left out of the items; what items share further on is
matched for each. Leaked spans can be cut out of the documents; a document of which they cover more than
COVERAGE goes as a whole.

Lead-ins are counted over all items before anything is sent. Items then go to the executors in blocks of
at most BLOCK_WORDS words (or one item, if that is longer), each by a broadcast of its own and a scan of its
own; the driver holds one block at a time, a Python worker one automaton, which it keeps between tasks. So
the answer does not depend on the blocks.

Defined cases: null and empty texts leak nothing; text, item and tag case, punctuation, markup and
spacing don't matter; repeated documents are all reported; equal items are each reported; an empty
benchmark or corpus gives an empty result, and leaves the corpus as it is. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ensure_checkpoint_dir, spread, table

_INLINE = re.compile(r"</?(?:em|strong|b|i|u|s|a|span|mark|code|sub|sup|font)\b[^<>\n]{0,80}>|[\u200b\u00ad\ufeff]", re.I)
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,6};|&#\d{1,5};")
_WORD = re.compile(r"[^\W_]+")
#: Words of test items in one automaton, some 100 MB of a worker.
BLOCK_WORDS = 100_000
#: Words of the shortest opening that counts as a lead-in.
LEAD = 6
#: Share of a document's words beyond which leaked spans take the whole document with them.
COVERAGE = 0.5
#: Rows that hold the spans of a document each, up to which they are broadcast.
FEW_SPANS = 200_000
_HELD: dict[str, LeakIndex] = {}


def words_of(text: str) -> list[str]:
    """Normalised words: tags and entities out, compatibility forms and marks folded, lower case."""
    if "<" in text or "&" in text or not text.isascii():
        text = _MARKUP.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


def _positions(text: str) -> list[tuple[int, int]]:
    """Where each of words_of(text) stands in the text."""
    chars = [(c, i) for i, c in enumerate(text)]

    def without(pattern: re.Pattern, fill: str) -> None:
        nonlocal chars
        out, at = [], 0
        for m in pattern.finditer("".join(c for c, _ in chars)):
            out += chars[at : m.start()] + [(fill, chars[m.start()][1])] * bool(fill)
            at = m.end()
        chars = out + chars[at:]

    if "<" in text or "&" in text or not text.isascii():
        without(_INLINE, "")
        without(_MARKUP, " ")
    flat = [(x, i) for c, i in chars for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)] if not text.isascii() else chars
    low = [(x, i) for c, i in flat for x in c.lower()]
    return [(low[m.start()][1], low[m.end() - 1][1] + 1) for m in _WORD.finditer("".join(c for c, _ in low))]


def lead_lengths(items: DataFrame, shared: int = 5) -> DataFrame:
    """(item_id, text, words, lead): the words of the longest opening that `shared` different texts have in common.

    Every opening of LEAD words or more is a hash; hashes of openings that recur are few, so they are copied
    over salts and no opening is hot in the join.
    """
    salts = 16

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in batch.itertuples(index=False, name=None):
                words = words_of(text)
                h, prints = xxhash.xxh64(), []
                for w in words:
                    h.update(w + " ")
                    prints.append(h.intdigest() - (1 << 63))
                rows.append((item, len(words), prints[LEAD - 1 :], prints[-1] if prints else 0))
            yield pd.DataFrame(rows, columns=["item_id", "words", "prints", "whole"])

    split = items.mapInPandas(openings, "item_id long, words long, prints array<long>, whole long")
    each = split.select("item_id", "whole", F.posexplode("prints").alias("k", "print"))
    common = each.select("print", "whole").distinct().groupBy("print").count().filter(F.col("count") >= shared).select("print", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    leads = each.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int")).join(common, ["print", "salt"]).groupBy("item_id").agg((F.max("k") + LEAD).alias("lead"))
    return items.join(split.select("item_id", "words"), "item_id").join(leads, "item_id", "left").select("item_id", "text", "words", F.coalesce("lead", F.lit(0)).alias("lead"))


class SuffixAutomaton:
    """A generalised suffix automaton over integer tokens; each item is ended by a token of its own."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first_end: list[int] = [-1]

    def _state(self, length: int, nxt: dict[int, int], link: int, end: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.first_end.append(end)
        return len(self.length) - 1

    def extend(self, last: int, token: int, end: int) -> int:
        """Add a token behind state `last`, which stands for everything read so far."""
        cur = self._state(self.length[last] + 1, {}, 0, end)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.first_end[q])
                while p != -1 and self.next[p].get(token) == q:
                    self.next[p][token] = twin
                    p = self.link[p]
                self.link[q] = self.link[cur] = twin
        return cur


class LeakIndex:
    """Test items as one automaton, with every place of a state found by walking its link tree."""

    def __init__(self, items: Sequence[tuple[int, str]], least: int = 20, seed: int = 5, density: float = 0.85, leads: Sequence[int] | None = None) -> None:
        self.least, self.seed, self.density = least, seed, density
        split = [(i, words_of(t or "")) for i, t in items]
        leads = [0] * len(split) if leads is None else leads
        self.items: list[int] = []
        self.text: list[int] = []
        self.at: list[int] = []
        vocabulary: dict[str, int] = {}
        auto, last = SuffixAutomaton(), 0
        for n, (item, w) in enumerate(split):
            for k, word in enumerate(w):
                token = -2 - len(self.text) if k < leads[n] else vocabulary.setdefault(word, len(vocabulary))
                last = auto.extend(last, token, len(self.text))
                self.text.append(token)
                self.at.append(n)
            last = auto.extend(last, -2 - len(self.text), len(self.text))
            self.text.append(-2 - len(self.text))
            self.at.append(-1)
            self.items.append(item)
        self.vocabulary = vocabulary
        self.next, self.link, self.length = auto.next, auto.link, auto.length
        # A tour of the link tree: the places of a state are the slice of the tour that its subtree takes.
        own: dict[int, list[int]] = defaultdict(list)
        state = 0
        for k, token in enumerate(self.text):
            state = self.next[state][token]
            own[state].append(k)
        below: list[list[int]] = [[] for _ in self.length]
        for s in range(1, len(self.length)):
            below[self.link[s]].append(s)
        self.tour: list[int] = []
        self.first, self.last = [0] * len(self.length), [0] * len(self.length)
        todo = [(0, False)]
        while todo:
            s, done = todo.pop()
            if done:
                self.last[s] = len(self.tour)
                continue
            self.first[s] = len(self.tour)
            self.tour += own[s]
            todo.append((s, True))
            todo += [(c, False) for c in below[s]]
        self.places = [b - a for a, b in zip(self.first, self.last)]

    def leaks(self, text: str) -> list[int]:
        """The items of which the text holds a passage."""
        return sorted({item for item, _, _ in self.passages(text)})

    def passages(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of the passages."""
        ids = list(map(self.vocabulary.get, words_of(text)))
        if len(ids) < self.least:
            return []
        nxt, link, length, places, seed = self.next, self.link, self.length, self.places, self.seed
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def close(state: int, size: int, end: int) -> None:
            lo = hi = None
            while size >= seed:  # shorter suffixes can stand in further items
                a, b = self.first[state], self.last[state]
                for place in self.tour[a:b] if lo is None else self.tour[a:lo] + self.tour[hi:b]:
                    runs[place - end].append((end - size + 1, end))
                lo, hi = a, b
                state = link[state]
                size = length[state]

        state = size = 0
        for i, token in enumerate(ids):
            to = nxt[state].get(token) if token is not None else None
            if size >= seed and (to is None or places[to] < places[state]):  # some item's match ends here
                close(state, size, i - 1)
            if to is not None:
                state, size = to, size + 1
                continue
            if token is None:
                state = size = 0
                continue
            while state and token not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(token)
            state, size = (to, size + 1) if to is not None else (0, 0)
        if size >= seed:
            close(state, size, len(ids) - 1)
        return sorted({(self.items[n], lo, hi) for d, spans in runs.items() for n, lo, hi in self._joined(ids, d, spans)})

    def _joined(self, ids: list[int], shift: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """Passages made of the agreeing words on one diagonal."""
        done = -1
        for a, b in sorted(spans):
            n = self.at[a + shift]
            if n < 0 or b <= done:
                continue
            lo, hi, same = a, b, b - a + 1
            for step in (-1, 1):
                i, misses, edge, gained, run = (a if step < 0 else b) + step, 0, 0, 0, 0
                while 0 <= i < len(ids) and 0 <= i + shift < len(self.text) and self.at[i + shift] == n and self.text[i + shift] >= 0:
                    if ids[i] == self.text[i + shift]:
                        run += 1
                        gained += 1
                        misses = 0
                        if run >= 2:
                            edge, same_here = abs(i - (a if step < 0 else b)), gained
                    else:
                        misses += 1
                        run = 0
                        if misses > 2:
                            break
                    i += step
                if edge:
                    same += same_here
                    lo, hi = (lo - edge, hi) if step < 0 else (lo, hi + edge)
            if hi - lo + 1 >= self.least and same >= self.density * (hi - lo + 1):
                done = hi
                yield n, lo, hi


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str, int]]]:
    """Blocks of (item, text, lead); the driver holds one at a time."""
    block, room = [], BLOCK_WORDS
    for item, text, words, lead in items.orderBy("item_id").toLocalIterator():
        if words > room and block:
            yield block
            block, room = [], BLOCK_WORDS
        block.append((item, text, lead))
        room -= words
    if block:
        yield block


def _index(key: str, block: list[tuple[int, str, int]]) -> LeakIndex:
    """A worker's automaton: built for its first task, kept for the next ones."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = LeakIndex([(i, t) for i, t, _ in block], leads=[n for _, _, n in block])
    return _HELD[key]


def leak_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first, last): the word numbers of every leaked passage; one narrow pass over the corpus per block."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    known = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("item_id IS NOT NULL").distinct()
    texts = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0), "doc_id")
    out = spark.createDataFrame([], "doc_id long, item_id long, first int, last int")
    for block in _blocks(lead_lengths(known).checkpoint()):
        sent, key = spark.sparkContext.broadcast(block), str(uuid.uuid4())

        def scan(batches: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            index = _index(key, sent.value)
            for batch in batches:
                rows = [(d, *p) for d, t in zip(batch["doc_id"], batch["text"]) for p in index.passages(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first", "last"]).astype("int64")

        out = out.unionByName(texts.mapInPandas(scan, "doc_id long, item_id long, first int, last int"))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) for every document and item of which it holds a passage."""
    return leak_spans(docs, items, doc_id, text, item_id, item_text).select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()


def without_spans(text: str, spans: list[tuple[int, int]], coverage: float = COVERAGE) -> tuple[str | None, int, float]:
    """(the text without the words of the spans, words removed, their share); no text where the share is beyond the limit."""
    where = _positions(text)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    removed = sum(b - a + 1 for a, b in merged)
    share = removed / len(where)
    if share > coverage:
        return None, removed, share
    parts, at = [], 0
    for a, b in merged:
        parts.append(text[at : where[a][0]])
        at = where[b][1]
    return "".join(parts) + text[at:], removed, share


def clean_documents(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text, removed_words, coverage, dropped) of every document.

    Spans are narrow; they are broadcast if at most FEW_SPANS documents have some, else joined.
    """
    each = leak_spans(docs, items).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")).checkpoint()
    spans = F.broadcast(each) if each.count() <= FEW_SPANS else each

    @F.pandas_udf("text string, removed long, share double")
    def cut(text: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = [(t, 0, 0.0) if f is None or not t else without_spans(t, [(r["first"], r["last"]) for r in f], coverage) for t, f in zip(text, found)]
        return pd.DataFrame(rows, columns=["text", "removed", "share"])

    kept = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    done = kept.filter("spans IS NOT NULL").withColumn("c", cut("text", "spans")).select("doc_id", "c.text", F.col("c.removed").alias("removed_words"), F.col("c.share").alias("coverage"))
    same = kept.filter("spans IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("removed_words"), F.lit(0.0).alias("coverage"))
    return done.unionByName(same).withColumn("dropped", F.col("coverage") > coverage)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items of which they hold a passage of 20 words or more."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the leaked passages."""
    return clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
