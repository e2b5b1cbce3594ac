import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logweave.llm import quality_conv, quality_rules, toxicity
from logweave.llm.common import read_table, remainder

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, FOLDER, "documents"), read_table(spark, FOLDER, "labels")


def plain_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[n : n + 3]) for n in range(len(words) - 2))
    repeated = {n + k for n in range(len(words) - 2) for k in range(3) if windows[tuple(words[n : n + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed


def test_base_figures(make, odd_rows, spark):
    model = quality_rules.Model(np.zeros(quality_rules.KINDS * quality_rules.BUCKETS), 5.0, (1.0, 0.0))
    rows = odd_rows + [(300, "a b c a b c a b\na b c\n\n \nx#\nx# \nx#"), (301, "k " * 99)]
    found = sorted((str(r.doc_id), *r[1:7], r.kept) for r in quality_rules.judge(make(rows), model).collect())
    assert found == sorted((str(d), *plain_figures(t), not plain_figures(t)[5]) for d, t in rows)
    assert quality_rules.judge(make([]), model).count() == 0


def test_rules_model(tables):
    documents, labels = tables
    aside = labels.filter(remainder("doc_id", 4) == 1)
    model = quality_rules.train(documents, labels.join(aside, "doc_id", "left_anti"))
    rows = quality_rules.judge(documents, model).join(aside, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean(good) > 0.97
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.9


def test_without_labels(make, odd_rows, spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make(odd_rows)
    assert quality_rules.good_documents(docs, labels).columns == docs.columns
    assert toxicity.clean_documents(docs, labels).count() == docs.count()
    assert quality_conv.score(docs, quality_conv.train(docs, labels)).filter("predicted = 1").count() == docs.count()
    assert toxicity.clean_documents(make([]), labels).count() == 0


def held_out(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_toxicity(tables, make):
    documents, labels = tables
    model = toxicity.train(documents, labels)
    rows = toxicity.score(documents, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (held_out(r.doc_id, 3) == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    aside = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in aside if r.toxic == 1]) > 0.75
    assert np.mean([r.predicted for r in aside if r.toxic == 0]) < 0.02
    # A mention of a group, or another group in its place, leaves the score alone.
    scorer = toxicity.Scorer(*model)
    assert scorer("the woman and her muslim friend") == pytest.approx(scorer("the man and her hindu friend"), abs=0.02)
    assert scorer("") == pytest.approx(scorer("a gay man from a jewish family"), abs=0.05)
    odd = toxicity.score(make([(None, None), (1, ""), (1, "")]), model).collect()
    assert len(odd) == 3 and len({r.score for r in odd}) == 1


def test_counterfactual_term_matters():
    # An identity term that comes with the label more often than not.
    rows = [np.array([0, 1]) if n < 80 else np.array([1]) if n < 90 else np.array([], int) for n in range(200)]
    labels = np.array([1.0] * 80 + [0.0] * 120)
    swaps = [r[r != 1] for r in rows]
    loose, _ = toxicity.fit(rows, swaps, labels, 2, invariance=0.0)
    tight, _ = toxicity.fit(rows, swaps, labels, 2, invariance=5.0)
    assert loose[1] > 2 * tight[1] and tight[0] > 2


def test_swaps():
    assert toxicity.swapped("A Muslim man", 0) == "A jewish girl"
    assert toxicity.swapped("nothing here", 0).startswith("nothing here ")


def test_network_slopes():
    texts = [quality_conv.padded(t) for t in ("clean text here", "### junk ###" * 60, "x" * 700)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss(network):
        network.pairs = []
        logits = [float(network.chunk_logits(network.block_maxima(t)).mean()) for t in texts]
        return np.mean([np.logaddexp(0, z) - y * z for z, y in zip(logits, labels)])

    network = quality_conv.Network()
    slopes = quality_conv.slopes_of(network, texts, labels)
    for value, slope in ((network.tables, slopes[0]), (network.out, slopes[2]), (network.shift, slopes[1])):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        start, step = value[at], 1e-2
        value[at] = start + step
        up = loss(network)
        value[at] = start - step
        down = loss(network)
        value[at] = start
        assert (up - down) / (2 * step) == pytest.approx(float(slope[at]), rel=0.1, abs=1e-4)


def test_chunks_cover_the_text():
    for blocks in range(1, 60):
        covered = {b for s in quality_conv.chunk_starts(blocks) for b in range(s, s + quality_conv.CHUNK_BLOCKS)}
        assert set(range(blocks)) <= covered and max(quality_conv.chunk_starts(blocks)) < blocks


def test_conv_quality(tables, make):
    documents, labels = tables
    network = quality_conv.train(documents, labels, 2500)
    rows = [r for r in quality_conv.score(documents, network).join(labels, "doc_id").collect()]
    assert all(r.held_out == (held_out(r.doc_id, 5) == 0) for r in rows)
    aside = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in aside if r.quality == 1]) > 0.97
    assert np.mean([r.predicted for r in aside if r.quality == 0]) < 0.25
    odd = quality_conv.score(make([(None, None), (1, ""), (2, "y" * 500_000)]), network).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)


def test_every_kind_of_gram_has_its_own_buckets():
    hasher, size = quality_rules.Hasher(), quality_rules.BUCKETS
    for text, counts in [("", [0, 0, 0, 0]), ("a", [1, 0, 0, 0]), ("ab", [1, 0, 0, 0]), ("abc", [1, 0, 1, 0]), ("ab cd", [2, 1, 3, 2])]:
        grams = hasher.grams(text, text.split())
        assert [len(g) for g in grams] == counts
        assert all(((g >= n * size) & (g < (n + 1) * size)).all() for n, g in enumerate(grams))
    text = "ab cd ab cd"
    place, share = quality_rules.shares(hasher.features(text, text.split()))
    assert len(place) == len(set(place.tolist())) and abs(share.sum() - 4) < 1e-9
    counts = Counter(np.concatenate(hasher.grams(text, text.split())).tolist())
    assert set(counts) == set(place.tolist())
    assert len(quality_rules.shares(hasher.features(None, []))[0]) == 0
    # A pair depends on the order of its words.
    one, other = hasher.grams("a b", ["a", "b"])[1], hasher.grams("b a", ["b", "a"])[1]
    assert one.tolist() != other.tolist()
