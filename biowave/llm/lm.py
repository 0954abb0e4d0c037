"""Language-model scoring with a weighted backoff automaton.

States are histories of n-grams; an arc leads on by a word and carries its discounted probability, a failure arc leads to
the shorter history and carries the backoff weight. Every word of the training texts makes states, and so does every
n-gram. Texts are encoded once, in blocks: the hashes of a block's distinct words and its texts as numbers into them.

What a block has to learn about the corpus is always a sum by key, so one kind of exchange does it, in rounds. A block sends
the keys of its distinct n-grams with their counts in training texts; buckets of keys sum them and answer each block, and
say whether no other block has the key, and which block of all is the one that counts this n-gram as a kind. So the next round
can send histories with the kinds that a block counts after them, and n-grams one longer. What follows a history that no other
block has needs no asking, since the block has all of it. A key comes from a block at most once, however often it occurs,
so no word, pair or passage fills a bucket. Each block's texts are then walked from left to right over its part of the automaton.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.llm.common import checkpointed, materialize

BLOCK_CHARS = 8_000_000  # of a block's texts, about
BUCKET_KEYS = 1_000_000  # keys that one bucket gets, about
TASK_BYTES = 2 * BLOCK_CHARS  # of the texts that one task scores, about
ORDER = 3  # words of the longest n-gram
DISCOUNT = 0.75

BLOCKS = "block bigint, docs array<bigint>, train array<boolean>, ends array<int>, ids binary, words array<bigint>, tokens bigint"
SENT = "level int, bucket int, block bigint, keys binary, counts binary"
SAID = "level int, bucket int, block bigint, sums binary, kinds array<bigint>"
SCORES = "_id bigint, _train boolean, n_tokens bigint, n_known bigint, base_score double, score double"
#: the hashes of the start and the end of a text; words have theirs
START, END = 1, 2
SMALL = 32  # values from which compression pays
STRIP = 256  # words of a text that one step after the other reads; strips are read side by side


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers that are small most often: the planes of their bytes that aren't all zero, compressed."""
    v = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width]
    if len(v) < SMALL:
        return bytes([width]) + planes.tobytes()
    return bytes([width | 128]) + zstandard.compress(planes.T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    width, packed = data[0] & 127, data[0] > 127
    planes = np.frombuffer(zstandard.decompress(data[1:]) if packed else data, np.uint8, offset=0 if packed else 1)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T if packed else planes.reshape(-1, width)
    return out.view("<u8")[:, 0]


def _longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a history and the word after it, by the splitmix64 finalizer."""
    z = (history ^ (history >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def encoded(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of docs (_id, _text, _train): ids are numbers of words, the commonest first; words are their hashes.

    ends holds each text's last place in ids, exclusive. The end of a text isn't in ids; tokens counts those of training texts.
    """

    def block(number: int, ids: list, docs: list, train: list, vocabulary: dict) -> pd.DataFrame:
        ends = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary)).view(np.int64)
        tokens = int(((np.diff(ends, prepend=0) + 1) * np.array(train, bool)).sum())
        row = (number, docs, train, ends.astype(np.int32), _packed(rank[flat]), hashes[order], tokens)
        return pd.DataFrame([row], columns=[x.split()[0] for x in BLOCKS.split(", ")])

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        numbers = counter(first)
        vocabulary: dict = defaultdict(counter().__next__)
        ids, kept, train, chars = [], [], [], 0
        for part in parts:
            for doc, text, learn in zip(part["_id"].array, part["_text"], part["_train"], strict=True):
                words = (text or "").encode("utf-8").lower().split()  # at the six ASCII blanks, as bytes do
                ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                kept.append(None if pd.isna(doc) else int(doc))
                train.append(bool(learn))
                chars += len(text or "") + 16
                if chars >= block_chars:
                    yield block(next(numbers), ids, kept, train, vocabulary)
                    vocabulary = defaultdict(counter().__next__)
                    ids, kept, train, chars = [], [], [], 0
        if kept:
            yield block(next(numbers), ids, kept, train, vocabulary)

    return docs.mapInPandas(batch, BLOCKS)


class Grams:
    """A block's n-grams, n from 1: keys[n] are the sorted distinct ones, at[n] each place's number among them.

    place[n] are the places that have an n-gram, history[n] the number of the (n - 1)-gram before each of these.
    """

    def __init__(self, row, order: int):
        ends, ids = np.asarray(row.ends, np.int64), _unpacked(row.ids)
        words = np.r_[np.asarray(row.words, np.int64).view(np.uint64), np.array([START, END], np.uint64)]
        by = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[by] = np.arange(len(words), dtype=np.int32)
        lengths = np.diff(ends, prepend=0) + 1
        last = np.cumsum(lengths) - 1
        self.texts = len(ends)
        self.text = np.repeat(np.arange(len(ends), dtype=np.int32), lengths)
        self.learn = np.asarray(row.train, bool)[self.text]
        is_end = np.zeros(len(self.text), bool)
        is_end[last] = True
        word = np.full(len(is_end), rank[-1], np.int32)
        word[~is_end] = rank[ids.astype(np.int64)]
        start, hashes = rank[-2], words[by]
        depth = np.arange(len(word)) - np.repeat(last - lengths + 1, lengths)  # places before, in the text
        self.keys, self.at, self.place, self.history = {1: hashes}, {1: word}, {1: slice(None)}, {}
        self.starts = (int(start), int(np.asarray(row.train, bool).sum()))
        before = np.roll(word, 1)
        before[depth == 0] = start
        for n in range(2, order + 1):
            place = np.flatnonzero(depth >= n - 2)
            history = before[place]
            keys, at = np.unique(_longer(self.keys[n - 1][history], hashes[word[place]]), return_inverse=True)
            self.keys[n], self.at[n], self.place[n], self.history[n] = keys, at.astype(np.int32), place, history
            before = np.full(len(word), -1, np.int32)
            before[place] = at
            before = np.roll(before, 1)

    def counts(self, n: int) -> np.ndarray:
        """How often the training texts of the block have each n-gram; the start of a text counts once in each."""
        out = np.bincount(self.at[n][self.learn[self.place[n]]], minlength=len(self.keys[n]))
        if n == 1:
            out[self.starts[0]] = self.starts[1]
        return out

    def parents(self, n: int) -> np.ndarray:
        """The history of each n-gram."""
        out = np.zeros(len(self.keys[n]), np.int32)
        out[self.at[n]] = self.history[n]
        return out

    def met(self, n: int) -> np.ndarray:
        """The n-grams that are a history in this block."""
        out = np.zeros(len(self.keys[n]), bool)
        out[self.history[n + 1]] = True
        return out


def _rows(level: int, block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of SENT: sorted keys cut where their bucket changes."""
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    return [
        (level, int(bucket[a]), block, _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b]))
        for a, b in zip(cut, cut[1:], strict=False)
    ]


def _frames(rows: list[tuple], most: int = 256) -> Iterator[pd.DataFrame]:
    for a in range(0, len(rows), most):
        yield pd.DataFrame(rows[a : a + most], columns=[x.split()[0] for x in SENT.split(", ")])


class Known:
    """What a block knows after some rounds: n[k] sums of its k-grams in the corpus, types[k] kinds of words after them.

    alone[k]: no other block has the k-gram; mine[k]: this block is the one that counts it.
    """

    def __init__(self, grams: Grams, said: pd.DataFrame, levels: int, histories: int):
        self.grams, self.said = grams, said
        self.n, self.alone, self.mine, self.types = {}, {}, {}, {}
        for k in range(1, levels + 1):
            local = grams.counts(k)
            value, asked = 4 * local + 2 + (local > 0), self.asked(k)
            value[asked] = self.answers(k)
            self.n[k], self.alone[k], self.mine[k] = value >> 2, value & 2 > 0, value & 1
        for k in range(1, histories + 1):
            types, asked = np.where(self.alone[k], self.counted(k), self.n[k]), self.unsure(k)
            types[asked] = self.answers(-k) >> 2
            self.types[k] = types

    def answers(self, level: int) -> np.ndarray:
        """In the order of the sorted keys that were sent."""
        mine = self.said[self.said["level"] == level].sort_values("bucket")
        return np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, mine["sums"])]).astype(np.int64)

    def asked(self, k: int) -> np.ndarray:
        """The k-grams to ask for: from the third order on, those whose history other blocks have too."""
        return np.ones(len(self.grams.keys[k]), bool) if k < 3 else ~self.alone[k - 1][self.grams.parents(k)]

    def counted(self, k: int) -> np.ndarray:
        """The kinds of words after each k-gram that this block counts."""
        return np.bincount(self.grams.parents(k + 1), self.mine[k + 1], len(self.grams.keys[k])).astype(np.int64)

    def unsure(self, k: int) -> np.ndarray:
        """The histories of which this block can't know what follows: a history seen once has one kind of word after it."""
        return self.grams.met(k) & ~self.alone[k] & (self.n[k] > 1)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers: four times the sum of each key, 2 if one block has it only, 1 for the first block of those that count it."""
    group = group.sort_values("block", kind="stable")
    each = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in group["keys"]]
    keys, n = np.concatenate(each), np.concatenate([_unpacked(x) for x in group["counts"]]).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.add.reduceat(n, new)
    first = np.minimum.reduceat(np.where(n > 0, order, len(n)), new)  # rows come by block, whatever the order of equal keys is
    blocks = np.diff(np.r_[new, len(n)])
    out = np.empty_like(n)
    out[order] = np.repeat(4 * sums + 2 * (blocks == 1), blocks)
    out[first[first < len(n)]] += 1
    cut = np.cumsum([len(x) for x in each])[:-1]
    of_words = sums[(keys[new] != START) & (keys[new] != END)]
    kinds = [int(((of_words == k) if k else (of_words > 0)).sum()) for k in range(3)]
    rows = group[["level", "bucket", "block"]].assign(sums=[_packed(x) for x in np.split(out, cut)], kinds=None)
    rows["kinds"] = [kinds] + [None] * (len(rows) - 1)
    return rows


def _first_round(buckets: list[int]):
    """Words and pairs with their counts."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                grams = Grams(row, 2)
                for n in (1, 2):
                    yield from _frames(_rows(n, row.block, grams.keys[n], grams.counts(n), buckets[n]))

    return batch


def _next_round(r: int, order: int, buckets: list[int]):
    """(r + 1)-grams with their counts, and at the level 1 - r the histories of r-grams with the kinds counted after them."""

    def of(key, blocks: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            grams = Grams(row, min(r + 1, order))
            known = Known(grams, said, r, 0)
            if r < order:
                some = known.asked(r + 1)
                out += _rows(r + 1, row.block, grams.keys[r + 1][some], grams.counts(r + 1)[some], buckets[r + 1])
            some = known.unsure(r - 1)
            out += _rows(1 - r, row.block, grams.keys[r - 1][some], known.counted(r - 1)[some], buckets[r - 1])
        return pd.DataFrame(out, columns=[x.split()[0] for x in SENT.split(", ")])

    return of


class Automaton:
    """A block's part of the automaton, as arrays.

    State 0 is the root, which knows no history; the others are the block's histories of 1 .. order - 1 words that training texts have.
    level is a state's number of words, up where its failure arc leads (its history without the first word), weight the log10 backoff
    weight of that arc. An arc leads from source by word (a number in the block) to target, and gain is the log10 probability of the word
    there. The root has an arc for every word; another state has those of its n-grams that training texts have. The target is the
    longest state that the words so far end in. by_place[k] has, for each place of the block, the arc that leads on to it from its history
    of k - 1 words, or -1 where the automaton has none.
    """

    def __init__(self, grams: Grams, known: Known, order: int, figures: dict[str, float]):
        total, kinds, discount = figures["total"], figures["kinds"], figures["discount"]
        n, words = known.n, len(grams.keys[1])
        at = {k: np.full(len(grams.text), -1, np.int32) for k in range(1, order + 1)}
        for k, places in at.items():
            places[grams.place[k]] = grams.at[k]
        first = {k: 1 + sum(len(grams.keys[j]) for j in range(1, k)) for k in range(1, order + 1)}  # of the states, and arcs less one, of k words
        size = first[order]
        self.level, self.up, self.weight = np.zeros(size, np.int8), np.zeros(size, np.int32), np.zeros(size)
        # what the root has no arc for shares the discounts of all words
        p = np.where(n[1] > 0, (n[1] - discount) / max(total, 1), discount * kinds / total if total else 1.0)
        state = np.where(n[1] > 0, first[1] + np.arange(words), 0)
        self.start = int(state[grams.starts[0]])
        self.by_place = np.full((order + 1, len(grams.text)), -1, np.int32)
        self.by_place[1] = at[1]
        gains, targets, sources, read = [np.log10(p)], [state], [np.zeros(words, np.int64)], [np.arange(words)]
        up = np.zeros(words, np.int64)
        for k in range(2, order + 1):
            # the histories of k - 1 words as states, with their failure arcs
            own = slice(first[k - 1], first[k])
            share = 1 / np.maximum(n[k - 1], 1)
            fail = np.where(n[k - 1] > 0, DISCOUNT * known.types[k - 1] * share, 1.0)
            with np.errstate(divide="ignore"):  # an end is no history
                self.level[own], self.up[own], self.weight[own] = k - 1, up, np.log10(fail)
            # the n-grams of k words as their arcs
            places, parent = grams.place[k], grams.parents(k)
            shorter, last = np.zeros(len(grams.keys[k]), np.int64), np.zeros(len(grams.keys[k]), np.int64)
            shorter[grams.at[k]], last[grams.at[k]] = at[k - 1][places], at[1][places]
            p = np.maximum(n[k] - DISCOUNT, 0) * share[parent] + fail[parent] * p[shorter]
            there = n[k] > 0
            self.by_place[k, places] = np.where(there, first[k] - 1 + np.arange(len(there)), -1)[grams.at[k]]
            up = state[shorter]
            state = np.where(there, first[k] + np.arange(len(there)), up) if k < order else up
            gains.append(np.log10(p))
            targets.append(state)
            sources.append(np.where(there, first[k - 1] + parent, -1))
            read.append(last)
        self.gain, self.target, self.source, self.word = (np.concatenate(x) for x in (gains, targets, sources, read))
        self.order = order

    def walk(self, grams: Grams) -> np.ndarray:
        """The log10 probability of each token: all texts are read at once from left to right, each with its state.

        Long texts are read in strips. A strip begins with the order - 1 words before it, unscored, after which its state is that of the whole text.
        """
        lengths = np.bincount(grams.text, minlength=grams.texts)
        strips = -(-lengths // STRIP)
        of = np.repeat(np.arange(len(lengths)), strips)
        number = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
        lead = np.where(number > 0, self.order - 1, 0)
        begin = (np.cumsum(lengths) - lengths)[of] + number * STRIP - lead
        size = np.minimum(STRIP, lengths[of] - number * STRIP) + lead
        by = np.argsort(-size, kind="stable")
        lead, begin, size = lead[by], begin[by], size[by]
        state = np.where(lead > 0, 0, self.start)
        out = np.zeros(len(grams.text))
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -step, side="left"))  # the strips with a word here
            place, now, got = begin[:n] + step, state[:n].copy(), np.zeros(n)
            arc = self.by_place[self.level[now] + 1, place]
            while len(miss := np.flatnonzero(arc < 0)):
                got[miss] += self.weight[now[miss]]
                now[miss] = self.up[now[miss]]
                arc[miss] = self.by_place[self.level[now[miss]] + 1, place[miss]]
            state[:n] = self.target[arc]
            scored = step >= lead[:n]
            out[place[scored]] = (got + self.gain[arc])[scored]
        return out


def _walked(order: int, figures: dict[str, float]):
    def walk(key, blocks: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples():
            grams = Grams(row, order)
            known = Known(grams, said, order, order - 1)
            c, word = known.n[1], grams.at[1]
            base = np.log10((c + 1) / (figures["total"] + figures["kinds"] + 1))
            passed = Automaton(grams, known, order, figures).walk(grams)
            sums = [np.bincount(grams.text, x, grams.texts) for x in ((c > 0)[word], base[word], passed)]
            out.append(
                pd.DataFrame({
                    "_id": pd.array(list(row.docs), "Int64"), "_train": np.asarray(row.train, bool),
                    "n_tokens": np.bincount(grams.text, minlength=grams.texts), "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2],
                })
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])

    return walk


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_chars: int = BLOCK_CHARS,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """One row per document: id, learnt, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z) words and one end each. The model learns from the rows that meet `train`. score is the log10
    probability of the text by interpolated absolute discounting over n-grams of up to `order` words: words the training
    texts lack are one class, which gets what the root discounts; histories are the start and all training n-grams.
    Probabilities after a history sum to one. base_score adds one to each count. Words and n-grams are told apart by 64-bit hashes.

    Null and empty texts are only an end. Null ids keep their row; rows that repeat an id are texts each. Without
    training rows every word is unknown and scores are 0. An empty input gives an empty result; other columns are ignored.
    """
    if order < 2:
        raise ValueError("order is 2 or more")
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(size / TASK_BYTES))
    # dealt once and for all: answers come to the blocks in each round, blocks don't move again
    blocks = checkpointed(encoded(rows, block_chars).repartition(tasks, "block"))
    # a text has its words and an end; distinct words are a block's own
    words, places, total, ends = blocks.agg(
        *[F.coalesce(F.sum(x), F.lit(0)) for x in (F.size("words") + 2, F.element_at("ends", -1) + F.size("ends"), "tokens", F.size(F.filter("train", lambda t: t)))],
    ).first()
    buckets = [0, *[max(1, math.ceil(n / bucket_keys)) for n in (words, *[places] * (order - 1))]]

    def answered(sent: DataFrame) -> DataFrame:
        return materialize(sent.groupBy("level", "bucket").applyInPandas(_summed, SAID))

    def by_block(said: DataFrame, of: Callable, schema: str) -> DataFrame:
        """Each block with its answers, few blocks a task whatever the session's number of partitions."""
        right = said.drop("kinds").withColumnRenamed("block", "of_block").repartition(tasks, "of_block")
        return blocks.groupBy("block").cogroup(right.groupBy("of_block")).applyInPandas(of, schema)

    said = answered(blocks.mapInPandas(_first_round(buckets), SENT))
    kinds, once, twice = (x or 0 for x in said.where("level = 1").agg(*[F.sum(F.element_at("kinds", k)) for k in (1, 2, 3)]).first())
    figures = {"total": total, "kinds": kinds + (ends > 0), "discount": once / (once + 2 * twice) if once and twice else 0.5}
    for r in range(2, order + 1):
        said = said.union(answered(by_block(said, _next_round(r, order, buckets), SENT)))
    walked = by_block(said, _walked(order, figures), SCORES)
    return walked.select(
        F.col("_id").alias(id_col), F.col("_train").alias("learnt"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
