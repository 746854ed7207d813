import binascii
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmill.llm import kneser
from tests.llm.helpers import AWKWARD, WORD, docs


def words(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.c, self.ctx = Counter(), defaultdict(Counter)
        for t in texts:
            w = words(t)
            self.c.update(w)
            for a, b in zip(["<s>", *[("w", x) for x in w[:-1]]], w, strict=True):
                self.ctx[a][b] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.cont = Counter(b for m in self.ctx.values() for b in m)
        self.pairs = sum(self.cont.values())
        self.high = self.discounts(Counter(n for m in self.ctx.values() for n in m.values()))
        self.low = self.discounts(Counter(self.cont.values()))
        self.gamma = self.left(self.cont.values(), self.low) / self.pairs if self.pairs else 1.0
        self.totals = {a: (sum(m.values()), self.left(m.values(), self.high)) for a, m in self.ctx.items()}

    @staticmethod
    def discounts(n):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.0
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
        return [min(max(x, 0.0), k) for k, x in enumerate(d, 1)]

    @staticmethod
    def left(counts, d):
        return sum(d[min(x, 3) - 1] for x in counts)

    def p(self, a, b):
        c = self.cont[b]
        p1 = (c - self.low[min(c, 3) - 1] if c else 0) / max(self.pairs, 1) + self.gamma / (self.v + 1)
        if a not in self.ctx:
            return p1
        n, (total, rest) = self.ctx[a][b], self.totals[a]
        return max(n - (self.high[min(n, 3) - 1] if n else 0), 0) / total + rest / total * p1

    def score(self, text):
        w = words(text)
        base = sum(math.log10((self.c[x] + 1) / (self.n + self.v + 1)) for x in w)
        pairs = zip(["<s>", *[("w", x) for x in w[:-1]]], w, strict=True)
        return len(w), sum(x in self.c for x in w), base, sum(math.log10(self.p(a, b)) for a, b in pairs)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = {i for i, _ in rows if binascii.crc32(str(i).encode()) % 7 == 2}
    plain = Plain([t for i, t in rows if i not in out])
    got = {r.doc_id: r for r in kneser.op10_kneser_ney(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, (n, known, base, score) = got[i], plain.score(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, n, known, plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [got[i] for i in out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    p = Plain(["a b c a b", "a a", "b c d", ""])
    vocabulary = [*p.c, "unknown"]
    for a in ["<s>", ("w", "a"), ("w", "d"), ("w", "never")]:
        assert sum(p.p(a, b) for b in vocabulary) == pytest.approx(1.0)


def test_awkward_rows_and_small_flushes(spark, monkeypatch):
    d = docs(spark, AWKWARD)
    plain = Plain([r[1] for r in AWKWARD])
    model = kneser.fit(d, parts=4)
    got = kneser.score(d, model).collect()
    want = sorted(((r[0], *plain.score(r[1])) for r in AWKWARD), key=str)
    got = sorted(((r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=lambda r: str(r[:3]))
    want = sorted(want, key=lambda r: str(r[:3]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


def test_no_training_texts(spark):
    d = docs(spark, AWKWARD)
    model = kneser.fit(d.limit(0), parts=4)
    assert (model.train_tokens, model.vocabulary) == (0, 0)
    assert {r.score for r in kneser.score(d, model).collect()} == {0.0}
    assert kneser.score(d.limit(0), kneser.fit(d, parts=4)).collect() == []


def test_arrays_survive_the_file(tmp_path):
    a, b = np.arange(7, dtype=np.uint64), np.array([1, 2, 3], dtype=np.uint8)
    kneser.write_arrays(f"file://{tmp_path}/x/0", key=a, n=b, none=a[:0])
    got = kneser.map_arrays(f"file://{tmp_path}/x/0")
    assert all(np.array_equal(got[k], v) for k, v in (("key", a), ("n", b), ("none", a[:0])))


@pytest.mark.parametrize("kind", ["pair", "word"])
def test_a_lost_file_is_an_error(spark, sf_dir, kind):
    import os

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = kneser.fit(d, parts=8)
    assert model.written[kind].any()
    lost = int(np.flatnonzero(model.written[kind])[0])
    path = kneser._posix(f"{model.root}/{kind}/{lost}")
    os.unlink(path)
    with pytest.raises(Exception, match="FileNotFoundError|No such file"):
        kneser.score(d, model).collect()
