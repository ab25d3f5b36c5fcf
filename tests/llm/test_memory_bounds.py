"""What stands in memory at once is bounded, whatever the number of partitions or the size of a batch."""

import numpy as np
import public_tokenizers

from fixtures import prose
from fleetstat.llm import exact, langid

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_stores_of_an_executor_share_one_bound(spark):
    with exact._disk_state(spark):
        assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
        assert int(spark.conf.get("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB")) <= 200
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) is None


def test_lattices_of_few_words_stand_together(monkeypatch):
    p = langid.pieces(PIECES)
    prob = np.random.default_rng(3).random((len(p.names), 3))
    prob /= prob.sum(axis=0)
    words = sorted({w for text in prose(4, 60) for w in text.split()} | {f"{a}{b}{c}" for a in "abcdefghijklmnopqrs" for b in "abcdefghijklmnopqrs" for c in "abcdefghijklmnop"})
    sizes, whole = [], langid.Pieces.lattice
    monkeypatch.setattr(langid.Pieces, "lattice", lambda self, part: sizes.append(len(part)) or whole(self, part))
    got = langid.log_scores(p, words, prob)
    assert len(words) > 5_000 and max(sizes) <= 4_000 and sum(sizes) == len(words)
    monkeypatch.setattr(langid, "TOGETHER", len(words))
    assert np.allclose(langid.log_scores(p, words, prob), got, rtol=1e-12)
