import numpy as np
import public_tokenizers
import pytest

from plinth.llm import lengths
from plinth.llm.tokens import byte_bpe
from tests.llm.support import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_every_limit(spark):
    rows = corpus() + [(None, "<|endoftext|> is text", "en", "s")]
    sums = lengths.suffix_sums(lengths.encoded_lengths(frame(spark, rows, clashing=True), PATH, public_tokenizers.PATTERN)).cache()
    encoding = byte_bpe(PATH, public_tokenizers.PATTERN)
    n = np.array([len(encoding.encode_ordinary(t or "")) for _, t, *_ in rows])
    found = sums.collect()
    assert sorted(r["n_tokens"] for r in found) == sorted(set(n.tolist()))
    for r in found:
        over, up_to = n[n > r["n_tokens"]], n[n <= r["n_tokens"]]
        assert tuple(r)[1:7] == ((n == r["n_tokens"]).sum(), len(over), over.sum(), len(up_to), up_to.sum(), np.minimum(n, r["n_tokens"]).sum())
        assert r["quantile"] == pytest.approx(len(up_to) / len(n))
    limits = [0, 1, 5, 64, 100, 4096, 10**7]
    assert sorted(map(tuple, lengths.at_limits(sums, limits).collect())) == [(x, (n > x).sum(), np.minimum(n, x).sum()) for x in limits]
    for share in (0.01, 0.25, 0.5, 0.9, 1.0):
        assert lengths.quantile(sums, share) == np.quantile(n, share, method="inverted_cdf")


def test_long_histograms(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(0, 9000, 700)
    sums = lengths.suffix_sums(spark.createDataFrame([(int(x), 1) for x in n], "n_tokens long, docs long"))
    for r in sums.collect():
        assert r["kept_tokens"] == np.minimum(n, r["n_tokens"]).sum() and r["docs_over"] == (n > r["n_tokens"]).sum()


def test_empty(spark):
    sums = lengths.suffix_sums(lengths.encoded_lengths(frame(spark, []), PATH, public_tokenizers.PATTERN))
    assert sums.collect() == [] and lengths.quantile(sums, 0.5) is None
    assert [tuple(r) for r in lengths.at_limits(sums, [7]).collect()] == [(7, 0, 0)]
