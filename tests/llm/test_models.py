import itertools
import zlib

import numpy as np
import pytest

from lodestar.llm import classifier, crf, html_extract, labelled_pages, nbsvm, quality_rules
from lodestar.llm.dom_blocks import blocks

from .helpers import DOCUMENTS, documents, rows_of, table


def folder(spark, tmp_path, rows=None, labels=()):
    documents(spark, tmp_path, rows)
    table(spark, tmp_path, "labels", list(labels), "doc_id long, quality int, toxic int")
    return str(tmp_path)


def test_held_out_accuracy(spark, oracle_dir):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{oracle_dir}/labels.parquet").collect()}
    rows = classifier.op4_classifier(spark, oracle_dir).collect()
    assert len(rows) == spark.read.parquet(f"{oracle_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and quality.get(r["doc_id"]) is not None]
    assert len(held) > 50 and np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) >= 0.97


def test_held_out_labels_are_never_learned(spark, oracle_dir, tmp_path):
    labels = spark.read.parquet(f"{oracle_dir}/labels.parquet").collect()
    docs = [(r["doc_id"], r["text"], None, None, None, None, None) for r in spark.read.parquet(f"{oracle_dir}/documents.parquet").collect()]
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    one = rows_of(classifier.op4_classifier(spark, oracle_dir), "doc_id", "score")
    two = rows_of(classifier.op4_classifier(spark, folder(spark, tmp_path, docs, flipped)), "doc_id", "score")
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 0), (9, 0, 0), (99, 1, 1), (3, None, 0), (None, 1, 0), (1, 0, 0)]])
def test_odd_tables(spark, tmp_path, labels):
    sf = folder(spark, tmp_path, None, labels)
    rows = classifier.op4_classifier(spark, sf).collect()
    assert len(rows) == len(DOCUMENTS) and all(0 <= r["score"] <= 1 for r in rows)
    got = rows_of(quality_rules.op9_quality_rules(spark, sf), "doc_id", "n_words", "base_failed")
    assert got == sorted(((r[0], len((r[1] or "").encode().split()), base(r[1])) for r in DOCUMENTS), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [(1, 1, 0)])
    assert classifier.op4_classifier(spark, sf).count() == quality_rules.op9_quality_rules(spark, sf).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    y = np.arange(200) % 2
    rows = [np.unique(np.r_[rng.integers(0, 50, 8), 60 + label]) for label in y]
    m = nbsvm.fit(rows, y, buckets=64)
    assert all((m.score(x) > 0.5) == bool(label) for x, label in zip(rows, y))


def plain_score(model, text):
    """The score of a text from a model's tables, gram by gram."""
    data, found, mask = (text or "").encode(), set(), (1 << 64) - 1
    bucket = lambda v: (v * 0x9E3779B97F4A7C15 & mask) >> (64 - 18)
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            found.add(bucket(int.from_bytes(bytes([n]) + data[i : i + n], "big")))
    words = data.split()
    back = [next((k for k in range(1, min(i, 31) + 1) if words[i - k] == w), 0) for i, w in enumerate(words)]
    for i in range(len(back) - 3):
        found.add(bucket((1 << 40) + sum(back[i + j] << 5 * j for j in range(4))))
    r = [float(model.ratio[x]) for x in found]
    length = max(sum(x * x for x in r) ** 0.5, 1e-12)
    margin = sum(float(model.weight[x]) * float(model.ratio[x]) for x in found) / length + model.bias
    return 1 / (1 + np.exp(-(model.a * margin + model.b)))


def test_scores_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = classifier.op4_classifier(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-6 for r in rows)


def test_the_sample_is_bounded_in_bytes(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    few = classifier.train(docs, labels, sample_bytes=20_000)
    assert (few.weight != 0).sum() < (classifier.train(docs, labels).weight != 0).sum()
    assert classifier.train(docs, labels, sample_bytes=0).bias == 0


def test_verdicts_by_brute_force(spark, oracle_dir):
    docs, labels = (spark.read.parquet(f"{oracle_dir}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.train(docs, labels)
    want = {}
    for r in docs.collect():
        n = dict(zip(quality_rules.COUNTS, quality_rules.counts(r["text"])))
        share = {k: n[of] / max(n[over], 1) for k, (over, of) in quality_rules.FEATURES.items()}
        low = any(all(share[c.feature] > c.cut if c.above else share[c.feature] <= c.cut for c in rule) for rule in rules)
        want[r["doc_id"]] = not base(r["text"]) and not low
    assert rules and {r["doc_id"]: r["kept"] for r in quality_rules.op9_quality_rules(spark, oracle_dir).collect()} == want


def test_indicators_are_distinct_ngrams():
    ind = nbsvm.Indicators()
    assert len(ind("")) == len(ind(None)) == 0
    a = ind("abab")
    assert len(a) == len(set(a.tolist())) == 2 + 2 + 2
    assert nbsvm.recurrences("x y x x z").tolist() == [0, 0, 2, 1, 0]


def base(text):
    words = (text or "").encode().split()
    return len(words) < 10 or 100 * repeats(words) > 20 * len(words)


def repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


@pytest.mark.parametrize(
    "text",
    [None, "", "a b c", "a b c d e a b c d e", "x " * 30, "# a\n\nb|c\nb|c\n \n \nB|C\n$$é &\t漢\x0bz y", "l1 w\r\nl1 w\r\n l1 w", "p q r s t u v w p q r s t u k"],
)
def test_counts(text):
    t = text or ""
    space = " \t\n\x0b\x0c\r"
    words = t.encode().split()
    lines = [x for x in t.split("\n") if x.strip(space)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    want = (len(words), sum(c not in space for c in t), sum(c in "#*$%&|<>" for c in t), dup, repeats(words))
    assert quality_rules.counts(text)[:5] == want


def test_rules_on_held_out_labels(spark, oracle_dir):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{oracle_dir}/labels.parquet").collect()}
    rows = quality_rules.op9_quality_rules(spark, oracle_dir).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and quality.get(r["doc_id"]) is not None and not r["base_failed"]]
    assert np.mean([r["kept"] == quality[r["doc_id"]] for r in held]) >= 0.95
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_rules_are_learned_pruned_and_ordered(spark):
    rng = np.random.default_rng(1)
    n = 3000
    table_ = {c: rng.integers(1, 50, n).astype(float) for c in quality_rules.COUNTS}
    table_["n_words"][:] = 100
    bad = (table_["n_symbols"] > 40) | ((table_["n_marks"] > 25) & (table_["n_upper_words"] > 30))
    rules = quality_rules.learn(table_, (~bad).astype(int))
    x = quality_rules.features(table_)
    got = np.zeros(n, bool)
    for r in rules:
        got |= quality_rules.covers(r, x, n)
    assert (got == bad).mean() > 0.97 and len(rules) <= 6
    df = spark.createDataFrame([tuple(int(table_[c][i]) for c in quality_rules.COUNTS) for i in range(200)], ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    assert [not r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == got[:200].tolist()
    assert quality_rules.learn({c: np.empty(0) for c in quality_rules.COUNTS}, np.empty(0, int)) == []


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    s, step, start = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    score = {y: start[y[0]] + sum(s[i, a] for i, a in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=6)}
    chain = crf.Chain({f"f{i}": i for i in range(6)}, [tuple(r) for r in s], tuple(start), (tuple(step[0]), tuple(step[1])))
    assert tuple(chain.decode([[f"f{i}", "unknown"] for i in range(6)])) == max(score, key=score.get)
    assert chain.decode([]) == []
    z = sum(map(np.exp, score.values()))
    node, edge = crf.marginals(s, step, start)
    assert np.allclose(node[:, 1], [sum(np.exp(v) for y, v in score.items() if y[i]) / z for i in range(6)])
    assert np.isclose(edge[0, 1], sum(np.exp(v) * sum(p == (0, 1) for p in itertools.pairwise(y)) for y, v in score.items()) / z)


def test_unseen_labelled_pages():
    chain, wrong, n = html_extract.trained(), 0, 0
    for k in range(300):
        markup, labels = labelled_pages.page(50_000 + k)
        seq = blocks(markup)
        assert len(seq) == len(labels)
        wrong += sum(a != b for a, b in zip(chain.decode(html_extract.features(seq)), labels))
        n += len(labels)
    assert wrong <= 0.01 * n


def test_blocks():
    page = "<title>t</title><body>a<br>b <b>c&amp;&copy;</b><p>d<p>e<!-- x > --><script>var t='</p>'</script>f<ul><li>g<li>h</ul>&nbsp;<td title='>'>i</td><style>p{}"
    assert [b.text for b in blocks(page)] == ["a b c&©", "d", "e f", "g", "h", "i"]
    assert blocks(None) == blocks("") == blocks("<p") == blocks("<!-- open <p>x") == []
    assert [b.text for b in blocks("x < y <3 </ p><p>z")] == ["x < y <3 </ p>", "z"]
    assert len(blocks("<div>" * 20_000 + "x")) == 1
    assert [b.text for b in blocks('<a href="' * 3000 + "x")] == []


def test_extract(spark, tmp_path, sf_dir):
    rows = [(1, "u", "<body><nav><a href=/>menu</a></nav><article><h1>Head</h1><p>One&nbsp;two\n three.</p><p>Four.</p></article><footer>&copy; x</footer>", 1), (None, None, None, 1), (2, "v", "", 1), (2, "v", "", 1)]
    table(spark, tmp_path, "pages", rows, "page_id long, url string, html string, text int")
    assert rows_of(html_extract.op5_html(spark, str(tmp_path))) == [(None, None, "", 0), (1, "u", "Head\n\nOne two three.\n\nFour.", 27), (2, "v", "", 0), (2, "v", "", 0)]
    table(spark, tmp_path, "pages", [], "page_id long, url string, html string, text int")
    assert html_extract.op5_html(spark, str(tmp_path)).count() == 0
    for r in html_extract.op5_html(spark, sf_dir).collect():
        assert r["text"] and r["n_chars"] == len(r["text"])


def test_blocks_keep_what_is_no_raw_text():
    for tag in "noscript template svg math canvas object audio video".split():
        assert " ".join(b.text for b in blocks(f"<p>a <{tag}>b</{tag}> c</p><p>d</p>")) == "a b c d"
        open_ = blocks(f"<div><{tag}>b</div><p>d</p>")
        assert [b.text for b in open_] == ["b", "d"] and not any(n.tag == tag for n in open_[1].path)
    assert [[n.tag for n in b.path] for b in blocks("<p>a<svg/></p><p>b</p>")] == [["p"], ["p"]]
    assert [b.text for b in blocks("<p>a<script>b</script><style>c</style></p>")] == ["a"]
