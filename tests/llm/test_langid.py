import zlib

import numpy as np
import pytest

from loomgrid.llm import langid


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    say = lambda letters: "".join(rng.choice(list(letters + "  "), 200))
    return langid.train([(lang, say(letters).encode()) for _ in range(60) for lang, letters in (("aa", "abcdef"), ("zz", "uvwxyz"))], steps=150)


def test_network_learns(network):
    names, scores = network.predict(["bad cafe feed", "xyz wux yyz", None, "", "123 !!", "a" * 100_000 + " xyz"])
    assert names == ["aa", "zz", "und", "und", "und", "aa"]
    assert (scores >= 0).all() and (scores <= 1).all() and scores[2] == 0


def test_windows_cover_whole_texts():
    texts = [b"x" * 700, b"", b"y" * 256, b"z"]
    data, row, size = langid.windows(texts)
    assert row.tolist() == [0, 0, 0, 1, 2, 3] and size.tolist() == [256, 256, 188, 0, 256, 1]
    assert (data > 0).sum() == sum(map(len, texts))


def test_learning_lowers_the_loss():
    rng = np.random.default_rng(1)
    samples = [(lang, bytes(rng.integers(low, low + 20, 300).tolist())) for _ in range(20) for lang, low in (("a", 60), ("b", 90))]
    before, after = langid.train(samples, steps=0), langid.train(samples, steps=60)
    data = np.concatenate([langid.windows([t])[0] for _, t in samples])
    truth = np.repeat([[0, 0, 1, 1]], 20, 0).ravel()
    loss = lambda net: -net.log_probabilities(data)[np.arange(len(data)), truth].mean()
    assert loss(after) < 0.2 * loss(before)


def exact(network):
    """The same network in double precision."""
    return langid.Network(network.langs, *[getattr(network, n).astype(float) for n in ("embed", "filters", "shift", "out", "bias")])


def test_forward_pass_against_plain_loops(network):
    net, text = exact(network), b"a bad xyz cafe"
    data = langid.windows([text])[0]
    padded = data[0].tolist() + [0] * (max(langid.WIDTHS) - 1)
    top = []
    for k, width in enumerate(langid.WIDTHS):
        for f in range(langid.FILTERS):
            column = k * langid.FILTERS + f
            best = -np.inf
            for at in range(langid.WINDOW):
                answer = 0.0
                for i in range(width):
                    for e in range(langid.EMBED):
                        answer += net.embed[padded[at + i]][e] * net.filters[i * langid.EMBED + e][column]
                best = max(best, answer)
            top.append(max(best + net.shift[column], 0.0))
    z = [sum(t * net.out[i][c] for i, t in enumerate(top)) + net.bias[c] for c in range(2)]
    want = np.array(z) - np.log(np.exp(np.array(z) - max(z)).sum()) - max(z)
    assert np.allclose(net.log_probabilities(data)[0], want, atol=1e-9)
    assert np.allclose(network.log_probabilities(data)[0], want, atol=1e-3)


def test_gradients_match_numeric_differences(network):
    net, rng = exact(network), np.random.default_rng(2)
    data = np.concatenate([langid.windows([t])[0] for t in (b"bad cafe vu", b"xyz wux", b"fed xa")])
    truth = np.array([0, 1, 0])
    _, grads = langid.gradients(net, data, truth)
    loss = lambda: langid.gradients(net, data, truth)[0]
    for param, grad in zip((net.embed, net.filters, net.shift, net.out, net.bias), grads):
        places = np.argwhere(np.abs(grad) > 1e-6) if param is net.embed or param is net.filters else np.argwhere(np.ones_like(param))
        for at in map(tuple, places[rng.permutation(len(places))[:12]]):
            old, step = param[at], 1e-6
            param[at] = old + step
            up = loss()
            param[at] = old - step
            down = loss()
            param[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5 + 1e-3 * abs(grad[at])


@pytest.mark.parametrize("text, letter", [("x", True), ("1 é", True), ("字", True), ("\u01c5", True), ("\u02b0", True), ("² ½ ① Ⅷ", False), ("12 !_", False), ("\u0301", False)])
def test_letters_are_those_of_unicode(network, spark, text, letter):
    assert langid.has_letter(text) == letter == (network.predict([text])[0] != ["und"])
    assert spark.createDataFrame([(text,)], "t string").selectExpr(r"t rlike r'\p{L}' as y").first().y == letter


def test_one_network_for_many_languages_is_bounded(spark):
    rows = [(i, f"text number {i}", f"lang{i % 9}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    original = langid.train
    langid.train = lambda samples: seen.append(samples) or original(samples, steps=1)
    try:
        langid.learn(docs, most_rows=18)
    finally:
        langid.train = original
    assert len({part for _, part in seen[0]}) == 18 and len({lang for lang, _ in seen[0]}) == 9


def test_query_on_real_rows(spark):
    from loomgrid.llm.queries import op4_langid

    sf = "/root/testdata/sf0.01"
    out = op4_langid(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both.held_out == both.doc_id.map(held)).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.97


def test_odd_rows(documents, no_documents, clashing):
    out = {r.doc_id: r for r in langid.identify(documents).collect() if r.doc_id is not None}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (22, 23, 24, 27)) and out[25].lang_pred == "en"
    assert langid.identify(documents).count() == documents.count() == langid.identify(clashing).count()
    assert langid.identify(no_documents).count() == 0


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = [(i, "abc def", "only" if held(i) else "seen") for i in range(60)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"seen"}
