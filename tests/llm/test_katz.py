"""Katz backoff against a plain dictionary of n-grams."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dwellspan.llm import katz

from .conftest import ODD_TEXTS


class Plain:
    """The same model by recursion over dictionaries; histories are tuples, () the end and the start."""

    def __init__(self, rows, order, kept=5):
        self.rows = [(i, [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t, *_ in rows]
        self.held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in self.rows]
        self.kept, self.order = kept, order
        self.counts = [Counter() for _ in range(order + 1)]
        for (_, words), held in zip(self.rows, self.held):
            if not held:
                for at in range(len(words) + 1):
                    for k in range(1, order + 1):
                        if g := self.gram(words, at, k):
                            self.counts[k][g] += 1
        self.starts = self.held.count(False)
        self.d = [None] + [katz.discounts([sum(c == r for c in self.counts[k].values()) for r in range(1, kept + 2)]) for k in range(1, order + 1)]
        self.total = sum(self.counts[1].values())
        left = sum((1 - self.kept_share(1, c)) * c for c in self.counts[1].values())
        self.bottom = self.total + (not left > 1e-12)
        self.unknown = (left if left > 1e-12 else 1) / self.bottom
        self.after = [None, None] + [{} for _ in range(order - 1)]
        for k in range(2, order + 1):
            for g in self.counts[k]:
                self.after[k].setdefault(g[:-1], []).append(g[-1])
        self.weights = {}

    def gram(self, words, at, k):
        tokens = ["<s>", *words, "</s>"]
        return tuple(tokens[at + 2 - k : at + 2]) if at + 2 - k >= (0 if k > 1 else 1) else None

    def kept_share(self, k, c):
        return self.d[k][min(c, self.kept + 1)]

    def of(self, history):
        return self.starts if history == ("<s>",) else self.counts[len(history)].get(history, 0)

    def weight(self, history):
        """Denominator and backoff weight of a learned history."""
        if history not in self.weights:
            k = len(history) + 1
            words, of = self.after[k][history], self.of(history)
            left = sum((1 - self.kept_share(k, self.counts[k][history + (w,)])) * self.counts[k][history + (w,)] for w in words)
            bottom = of + (not left > 1e-12)
            self.weights[history] = bottom, (left if left > 1e-12 else 1) / bottom / (1 - sum(self.p(w, history[1:]) for w in words))
        return self.weights[history]

    def p(self, word, history):
        if not history:
            c = self.counts[1].get((word,), 0)
            return self.kept_share(1, c) * c / self.bottom if c else self.unknown
        k = len(history) + 1
        if history not in self.after[k]:
            return self.p(word, history[1:])
        bottom, weight = self.weight(history)
        c = self.counts[k].get(history + (word,), 0)
        return self.kept_share(k, c) * c / bottom if c else weight * self.p(word, history[1:])

    def scores(self):
        for (i, words), held in zip(self.rows, self.held):
            tokens, score, base, known = ["<s>", *words, "</s>"], 0.0, 0.0, 0
            for at in range(1, len(tokens)):
                score += math.log10(self.p(tokens[at], tuple(tokens[max(0, at - self.order + 1) : at])))
                c = self.counts[1].get((tokens[at],), 0)
                known += c > 0
                base += math.log10((c + 1) / (self.total + len(self.counts[1]) + 1))
            yield i, held, len(words) + 1, known, self.total, base, score


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus_rows(n, seed=4):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "é", "the", "THE"]
    rows = []
    for i in range(n):
        words = ["the"]
        while dice.random() < 0.96:
            words.append(vocabulary[min(int(dice.expovariate(0.08)), 63)] if dice.random() < 0.9 else f"{words[-1][:4]}x")
        rows.append((i, " ".join(words)))
    return rows + [(n + 1, rows[0][1]), (n + 2, rows[0][1])]


def compared(got, plain):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(plain.scores(), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, corpus, order):
    rows = corpus_rows(150) + [(i and i + 1000, t) for i, t in ODD_TEXTS]
    got = katz.fitted(spark.read.parquet(f"{corpus(rows)}/documents.parquet"), order=order).scored().collect()
    compared(got, Plain(rows, order))


def test_hot_histories(spark, corpus):
    """With histories that are dealt to several buckets."""
    rows = corpus_rows(200, 5)
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    many, plain = katz.fitted(docs, hot=20), Plain(rows, 2)
    compared(many.scored().collect(), plain)
    assert many.ngrams(2).count() == len(plain.counts[2])
    words = {r["word"]: r["count"] for r in many.words().collect() if r["count"]}
    assert words == {g[0]: c for g, c in plain.counts[1].items() if g[0] != "</s>"}


def test_normalised():
    plain = Plain(corpus_rows(80), 2)
    words = [g[0] for g in plain.counts[1]]
    for history in [(), ("<s>",), ("the",), ("w3",)]:
        assert sum(plain.p(w, history) for w in words) + plain.p("?", history) == pytest.approx(1, abs=1e-12)


def test_no_training_rows(spark, corpus):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = katz.op12_katz_backoff(spark, corpus([(i, "a b") for i in held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert katz.op12_katz_backoff(spark, corpus([(1, "x")])).count() == 1
    assert katz.fitted(spark.read.parquet(f"{corpus([(1, 'x')])}/documents.parquet").where("false")).scored().count() == 0


def test_packing_of_numbers():
    dice = np.random.Generator(np.random.PCG64(2))
    for top in (1, 300, 70_000, 1 << 40, 1 << 62):
        v = dice.integers(0, top, 1000)
        assert (katz.unpacked(katz.packed(v)) == v).all()
        assert (katz.unpacked(katz.packed(np.sort(v), True), True) == np.sort(v)).all()
    assert len(katz.unpacked(katz.packed([]))) == len(katz.unpacked(katz.packed([], True), True)) == 0


def test_discounts():
    assert katz.discounts([0] * 6).tolist() == [1, 0.5, 1, 1, 1, 1, 1]
    d = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1
