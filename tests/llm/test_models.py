"""Language ID, quality rules, co-training and URL filter: held-out accuracy, brute-force statistics and odd rows."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import cotrain, language_id, quality_rules, url_filter

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, None), (None, "the the the", "en", "s"), (2, "", "en", "s"), (3, "1234 !!", "en", "s"), (4, "word " * 30_000, "en", "s"), (4, "word " * 30_000, "en", "s")]
SCHEMA = "doc_id long, text string, lang string, score string"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_odd_rows(spark):
    model = {"langs": ["de", "en"], "weights": np.zeros((language_id.BUCKETS, 2), np.float32), "temperature": 1.0}
    for m in (model, None):
        got = language_id.predict(spark.createDataFrame(ODD, SCHEMA), m).collect()
        assert len(got) == len(ODD)
        by = {r.doc_id: r for r in got}
        assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1, 2, 3))
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.fit(empty) is None and language_id.predict(empty, model).collect() == []


def test_letters_are_those_of_the_letter_categories():
    texts = ["½ ² ٣ Ⅷ 123 !?", "", "ª", "é", "中", "\u0301", "x1"]
    assert [language_id.has_letter(t) for t in texts] == [any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]


def test_accepted_rows_keep_their_columns(spark):
    """Rows are judged one by one, whatever their ids; without a model all with a letter stay."""
    rows = [(1, None, "en", "s"), (1, "good words", "en", "s"), (None, "more good words", "en", "s"), (None, "12 ½", "en", "s"), (1, "good words", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").withColumn("lang_pred", F.lit("q")).withColumn("c0", F.lit(1))
    model = {"langs": ["de", "en"], "weights": np.zeros((language_id.BUCKETS, 2), np.float32), "temperature": 1.0}
    for m in (model, None):
        out = language_id.accepted(docs, m, 0.3)
        assert out.columns == docs.columns
        assert sorted((r.doc_id is None, r.text, r.score, r.lang_pred) for r in out.collect()) == [(False, "good words", "s", "q")] * 2 + [(True, "more good words", "s", "q")]
    assert language_id.accepted(docs, model, 0.9).collect() == []


def test_every_language_is_learned_from_a_bounded_part(spark):
    """More languages than any former limit, equal texts and null ids: the fit has each, and does not change with partitioning."""
    rows = [(None, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} {i % 7}x", f"l{k:03d}", None) for k in range(230) for i in range(12)]
    one, two = (language_id.fit(spark.createDataFrame(rows, SCHEMA).repartition(n), sample=5) for n in (2, 5))
    assert len(one["langs"]) == 230 and (one["weights"] == two["weights"]).all() and one["temperature"] == two["temperature"]


def test_quality_statistics_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text"))
    rows = docs.collect()
    got = sorted(tuple(r) for r in quality_rules.statistics(docs.filter("doc_id is not null")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = []
    for d, t in rows:
        if d is None:
            continue
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        v = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(v)
        covered = {j for i, x in enumerate(v) if c[x] > 1 for j in range(i, i + 5)}
        want.append((d, len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    assert got == sorted(want)


def test_learned_rules_find_a_planted_threshold():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    low = (x[:, 1] > 0.7) & (x[:, 2] < 0.5)
    rules = quality_rules.learn(x, low)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._covers(x, r)
    assert (hit == low).mean() > 0.95
    assert quality_rules.learn(x[:0], low[:0]) == [] and quality_rules.learn(x, np.zeros(600, bool)) == []


def test_quality_verdicts_equal_brute_force(spark):
    """base_failed and kept of every row, with the learned list read by a plain loop; an empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    names = list(quality_rules.measures())
    assert rules
    for r in quality_rules.judge(docs, rules).collect():
        n, c = max(r.n_words, 1), max(r.word_chars, 1)
        x = {"n_words": r.n_words, "n_dup_lines": r.n_dup_lines, "symbols_per_word": r.n_symbols / n, "repeat_share": r.n_repeat_words / n, "chars_per_word": r.word_chars / n, "upper_share": r.n_upper / c, "marks_per_word": r.n_marks / n}
        low = any(all(x[names[j]] >= t if op == ">=" else x[names[j]] < t for j, op, t in rule) for rule in rules)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed and not low)
    assert quality_rules.judge(docs.limit(0), rules).collect() == []


def halves(spark):
    """Documents, and labels in two halves by a hash of the doc_id."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return docs, labels.filter(half == 0), {r.doc_id: r.quality for r in labels.filter(half == 1).collect()}


def test_rules_on_held_out_labels(spark):
    docs, known, held = halves(spark)
    got = [(held[r.doc_id], r.kept) for r in quality_rules.judge(docs, quality_rules.fit(docs, known)).collect() if r.doc_id in held]
    assert np.mean([k for q, k in got if q == 1]) > 0.95 and np.mean([k for q, k in got if q == 0]) < 0.2


def test_co_training_on_held_out_labels(spark):
    """Scores of documents whose labels the fit has not seen; both views together are no worse than the text view."""
    docs, known, held = halves(spark)
    rows = [(held[r.doc_id], r.score, r.p_text) for r in cotrain.classify(docs, cotrain.fit(docs, known)).collect() if r.doc_id in held]
    y = np.array([q for q, _, _ in rows]) == 1
    right = [((np.array(p) >= 0.5) == y).mean() for p in zip(*((s, t) for _, s, t in rows))]
    print("held-out accuracy of both views and of the text view", right)
    assert right[0] > 0.9 and right[0] >= right[1] - 0.005


def test_co_training_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert cotrain.fit(odd, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert [r.score for r in cotrain.classify(odd, None).collect()] == [1.0] * len(ODD)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = cotrain.fit(docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")), labels)
    got = cotrain.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert cotrain.classify(odd.limit(0), model).collect() == []


def test_co_training_rounds_teach_the_other_view():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    rows = [[(np.array([2 * v + c]), np.ones(1)) for c in y] for v in (0, 1)]
    labels = np.where(np.arange(400) < 20, y, -1)
    w = cotrain.co_train(rows, labels, [4, 4])
    assert all(((cotrain._logits(rows[v], w[v]) > 0) == (y == 1)).all() for v in (0, 1))


def test_co_training_reaches_every_unlabelled_document(spark, monkeypatch):
    """The rows that each view tells are the surest of all unlabelled ones, by brute force over more than 2,000 of them."""
    monkeypatch.setattr(cotrain, "PER_ROUND", 7)
    rng = np.random.default_rng(4)
    rows = [(None if d == 5 else d, " ".join(rng.choice(["ab", "cd", "xy", "qz"], 3 + d % 9)), "en", f"s{d % 40}") for d in range(3000)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, lang string, source string").repartition(5)
    known = spark.createDataFrame([(d,) for d in range(0, 3000, 10)], "doc_id long")
    w = [rng.normal(0, 0.2, 1 << cotrain.BITS), rng.normal(0, 3, 1 << cotrain.META_BITS)]
    pool = cotrain.Unlabelled(docs, known)
    got = [pool.best(w), pool.best(w)]
    model = {"text": (100 * w[0]).astype(np.float32), "meta": w[1]}
    z = {r.key: (r.z0, r.z1) for r in pool.rows.mapInArrow(cotrain._logged(model), "doc_id long, key long, z0 double, z1 double").collect() if r.doc_id is None or r.doc_id % 10}
    assert len(z) == 2700
    for v in (0, 1):
        for y, sign in ((1, 1), (0, -1)):
            best = sorted((k for k in z if sign * z[k][v] >= np.log(19)), key=lambda k: (-sign * z[k][v], k))
            assert len(best) > 14
            assert [[k for a, b, k in g if (a, b) == (v, y)] for g in got] == [best[:7], best[7:14]]
    told = pool(w)
    assert len(told) == 28 and all(len(f) == 2 for _, f, _ in told)


def test_url_rules_and_parts(spark):
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x", "http://b.org", "http://c.org/x", "http://m.site.com/fr/2#t", "http://m.site.com/de/2", "nothing", None, "x://notexample.org/es/1", "http://com/fr/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][:3] == ("b.org", "", None)
    assert got[3] == ("c.org", "/x", "org/", "allow")
    assert got[4] == ("m.site.com", "/fr/2", "com/fr/", "allow") and got[5] == ("m.site.com", "/de/2", "com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2] == "org/" and got[9][2] == "com/fr/"


def brute_rule(host, path):
    fits = [(len(r), r, v) for v, r in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_verdicts_equal_brute_force(spark):
    """Hosts, paths, rules and probabilities of every page, url by url."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    cut = lambda u: re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups() if u and "://" in u else ("", "")
    split = {k: (h.translate({i: i + 32 for i in range(65, 91)}), p) for k, (h, p) in ((k, cut(u)) for k, u in urls.items())}
    w, b = url_filter.train([(*cut(u), y) for u, y in sorted(url_filter.labelled_urls())])
    for r in url_filter.filter_urls(pages).collect():
        rule, verdict = brute_rule(*split[r.page_id])
        p = url_filter.probabilities([r.host], [r.path], w, b)[0]
        assert (r.host, r.path, r.rule) == (*split[r.page_id], rule) and abs(p - r.p_block) < 1e-3
        assert r.verdict == (verdict or ("block" if r.p_block >= url_filter.THRESHOLD else "allow"))


def _folds(urls, of):
    """(rows to learn from, rows held out) of four folds, dealt by a checksum of what `of` finds in a URL."""
    rows = [(*re.match(r"https?://([^/]*)([^?]*)", u).groups(), y) for u, y in urls]
    folds = [zlib.crc32(of(u).encode()) % 4 for u, _ in urls]
    for fold in range(4):
        yield [r for r, f in zip(rows, folds) if f != fold], [r for r, f in zip(rows, folds) if f == fold]


def test_url_model_on_held_out_rows_and_names():
    """New hosts of words that the fit has seen get their label; words and names that it has not seen are allowed."""
    urls, least = url_filter.labelled_urls(), url_filter.THRESHOLD
    right = {0: [], 1: []}
    for learn, held in _folds(urls, lambda u: u):
        w, b = url_filter.train(learn)
        for (*_, y), p in zip(held, url_filter.probabilities([h for h, _, _ in held], [p for _, p, _ in held], w, b)):
            right[y].append((p >= least) == (y == 1))
    print("held-out accuracy of wanted and unwanted rows", [np.mean(right[y]) for y in (0, 1)])
    assert np.mean(right[0]) > 0.99 and np.mean(right[1]) > 0.82
    known, allowed = {*url_filter.UNWANTED, *url_filter.WANTED}, {0: [], 1: []}
    word = lambda u: max((w for w in known if w in u), key=len, default=u)
    for learn, held in _folds(urls, word):
        w, b = url_filter.train(learn, steps=200)
        for (*_, y), p in zip(held, url_filter.probabilities([h for h, _, _ in held], [p for _, p, _ in held], w, b)):
            allowed[y].append(p < least)
    print("share of rows of held-out words that are allowed, wanted and unwanted", [np.mean(allowed[y]) for y in (0, 1)])
    assert np.mean(allowed[0]) > 0.95
    w, b = url_filter.train([(*re.match(r"https?://([^/]*)([^?]*)", u).groups(), y) for u, y in urls])
    unknown = ["ququxa.example.com", "brizzle.test", "www.oolbe.example.org", "zmnrt.co"]
    assert (url_filter.probabilities(unknown, ["/en/4"] * 4, w, b) < least).all()
    new = ["grand-casino.test", "poker.brizzle.test", "city-library.test", "chess.brizzle.test"]
    assert (url_filter.probabilities(new, ["/a"] * 4, w, b) >= least).tolist() == [True, True, False, False]


def test_a_host_has_one_verdict_whatever_its_numbers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.filter_urls(pages).filter("rule is null").collect()
    bare = {}
    for r in got:
        bare.setdefault((r.host, re.sub(r"\d", "", r.path)), set()).add(r.verdict)
    assert len(bare) > 200 and all(len(v) == 1 for v in bare.values())
    bad = [r.verdict for r in got if re.search("casino|adult|spam|pills|bets", r.host)]
    assert len(bad) > 50 and set(bad) == {"block"}


def test_url_odd_rows(spark):
    rows = [(None, "http://casino.test/x", 1), (1, "http://a.test/" + "q" * 300_000, 1), (1, "http://a.test/x", 1), (1, "http://a.test/x", 1), (2, "HTTP://", 1), (3, "a://\nb.test/c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host long").withColumn("rule", F.lit("r")).withColumn("p_block", F.lit("r"))
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id is None} == {"block"} and all(r.rule is None for r in got)
    assert url_filter.filter_urls(df.limit(0)).collect() == []
    none = url_filter.filter_urls(df, labelled=spark.createDataFrame([(None, 1), ("http://x.test", None)], "url string, label int")).collect()
    assert len(none) == len(rows)
