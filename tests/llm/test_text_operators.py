import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, registry, secrets, urls
from tidemark.llm.quality import classify_quality
from tidemark.llm.toxicity import best_threshold, classify_toxicity

SF = "/root/testdata/sf0.001"
#: A schema with columns whose names the operators also use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, parts int, n_words int, mix_key int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s" if k % 3 else None, 1, "x", 1, 1, 1) for k, (i, t) in enumerate(texts)], SCHEMA)


ODD = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n\r\x0b "), (4, "x " * 40000), (5, "same same"), (5, "same same"), (6, "é" * 500 + "\n" + "日本 " * 60), (7, "One two three. " * 30), (8, "\n".join(f"Line{k} has{k} its{k} own{k} words{k} here{k}." for k in range(40))), (9, "a | b | c | d\n" * 30)]


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = list(zip(w, w[1:], w[2:], strict=False))
    hit = {p + k for p, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)} if len(tri) < 3000 else set(range(len(w)))
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit)


def test_line_rules(spark):
    got = lines.judge(frame(spark, ODD)).collect()
    assert [r.doc_id for r in got] == [i for i, _ in ODD]
    for r, (_, t) in zip(got, ODD, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t or ""), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    by = {r.doc_id: r for r in got}
    assert by[8].kept and not by[9].kept and not by[4].kept
    kept = lines.clean(frame(spark, ODD))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r.doc_id for r in kept.collect()} >= {8} and lines.judge(frame(spark, ODD).limit(0)).count() == 0


def test_repeated_windows_are_exact_whatever_the_hash(spark, monkeypatch):
    """With a hash that is the same, or nearly, for all words the counts are those of the words."""
    r = random.Random(4)
    texts = [(k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for k in range(80)] + ODD[:4]
    want = [base_counts(t or "")[4] for _, t in texts]
    for weak in (lambda z: F.lit(1).cast("long"), lambda z: F.pmod(F.xxhash64(z), F.lit(3)) * F.lit(1 << 61), F.xxhash64):
        monkeypatch.setattr(lines, "HASH", weak)
        assert [x.n_repeat_words for x in lines.judge(frame(spark, texts)).collect()] == want


def spans_of(t):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_secrets(spark):
    r = random.Random(1)
    signs = ["token", "TOKEN=", "secret:", "password = \"", "api_key=", "apikey", "'", "=", ": ", "abcdef0123456789", "abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "Z9", "é", "\n", " ", "😀", "aB3xY9kLmN0pQrStUvWx", "client_id=abc", "https://h.example", "host.example:8080", "g" * 300, "x" * 12]
    texts = [(k, "".join(r.choice(signs) for _ in range(r.randint(0, 25)))) for k in range(300)] + ODD
    got = secrets.report(frame(spark, texts)).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert len(got) == len(texts)
    mine = sorted([(i, digest(spans_of(t or "")), *[sum(s[1] == k for s in spans_of(t or "")) for k in range(3)]) for i, t in texts], key=lambda x: (key(x), x[1]))
    assert sorted([(x.doc_id, x.base_sha256, x.n_assign, x.n_access, x.n_hex) for x in got], key=lambda x: (key(x), x[1])) == mine

    alone = ["client_id=abc", "aB3xY9kLmN0pQrStUvWx", "https://h.example/"]
    cases = [(k, t) for k, t in enumerate([*alone, " ".join(alone), "client_id=abc " + "g" * 900 + " aB3xY9kLmN0pQrStUvWx", "AKIAABCDEFGHIJKLMN token=abcdefghijkl"])]
    found = {x.doc_id: [p.split(":")[0] for p in x.spans.split(",") if p] for x in secrets.report(frame(spark, cases)).collect()}
    assert found == {0: [], 1: [], 2: [], 3: ["client", "value", "endpoint"], 4: [], 5: ["access", "assign"]}
    shown = secrets.redact(frame(spark, cases))
    assert shown.columns == frame(spark, cases).columns and {x.doc_id: x.text for x in shown.collect()}[5] == "[SECRET] [SECRET]"
    assert secrets.report(frame(spark, ODD).limit(0)).count() == secrets.redact(frame(spark, ODD).limit(0)).count() == 0


def all_spans(t):
    """Base spans, and weak ones whose scope meets those of their complements: every pair is looked at."""
    parts = [*spans_of(t), *[(m.start(), k, m.end()) for k in (3, 4, 5) for m in re.finditer(secrets.PATTERNS[secrets.KINDS[k]], t)]]

    def meets(x, kinds):
        return any(y[1] in kinds and max(x[0], y[0]) - min(x[2], y[2]) <= 2 * secrets.SCOPE for y in parts)

    needs = {3: [(0, 2, 4)], 4: [(1, 3)], 5: [(1, 3), (0, 2, 4)]}
    return sorted(x for x in parts if x[1] < 3 or all(meets(x, kinds) for kinds in needs[x[1]]))


def redacted(t):
    out, at = [], 0
    for a, _, b in all_spans(t):
        if a >= at:
            out += [t[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def test_linked_secrets_against_all_pairs(spark):
    r = random.Random(8)
    signs = ["client_id=abc", "USER: bob", "aB3xY9kLmN0pQrStUvWx", "https://h.example/", "host.example:8080", "..a.b:443", "a.b.", "token=abcdefghijkl", "AKIAABCDEFGHIJKLMN", "abcdef0123456789", "é日😀", " ", "\n", "g" * 150, "g " * 190, "-" * 399, "-" * 3000]
    texts = [(k, "".join(r.choice(signs) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 40)))) for k in range(300)] + [(k + 300, t) for k, t in enumerate(["", None, None, "token=abcdefghijkl", "token=abcdefghijkl"])]
    got = {x.doc_id: x.spans for x in secrets.report(frame(spark, texts)).collect()}
    assert got == {k: ",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in all_spans(t or "")) for k, t in texts}
    assert sum("client" in x for x in got.values()) > 50 and sum("endpoint" in x for x in got.values()) > 50
    assert {x.doc_id: x.text for x in secrets.redact(frame(spark, texts)).collect()} == {k: t if t is None else redacted(t) for k, t in texts}


def test_secrets_in_very_long_texts(spark):
    """Texts that would overflow the stack, or take the square of their length, of a careless pattern or fold."""
    one = "client_id=abc x AKIAABCDEFGHIJKLMN0 "
    texts = [(1, "host:80 " + "a." * 100_000 + "b end"), (2, "token=abcdefghijkl " * 20_000), (3, one * 10_000), (4, "-" * 200_000 + " " + "a.b" * 70_000), (5, "aB" * 100_000 + "é" * 100_000)]
    began = time.time()
    got = {x.doc_id: x for x in secrets.report(frame(spark, texts)).collect()}
    clean = {x.doc_id: x.text for x in secrets.redact(frame(spark, texts)).collect()}
    assert time.time() - began < 400
    assert got[2].n_assign == 20_000 and got[2].base_sha256 == digest(spans_of(texts[1][1])) and clean[2] == "[SECRET] " * 20_000
    assert got[3].n_access == 10_000 and got[3].spans.count("client") == 0 and clean[3] == "client_id=abc x [SECRET] " * 10_000
    assert got[1].spans == got[4].spans == got[5].spans == "" and all(clean[k] == t for k, t in texts if k in (1, 4, 5))


def test_url_filter(spark):
    rows = [(1, "https://A.example.ORG/es/x?y=1"), (2, "http://example.org/en/12"), (3, "http://notexample.org/es/"), (4, "http://x.com/fr/a#b"), (5, "http://com/de/"), (6, "ftp://net.example.net"), (7, None), (8, ""), (9, "no scheme"), (9, "no scheme"), (None, "a://b?c"), (10, "http://org"), (11, "x" * 5000 + "://q/" + "9" * 5000)]
    got = urls.judge_urls(spark.createDataFrame([(*r, "h", "clash") for r in rows], "page_id long, url string, html string, host string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and by[2][2:] == ("example.org/en/1", "block")
    assert by[3][2:] == ("org/", "allow") and by[4] == ("x.com", "/fr/a", "com/fr/", "allow") and by[5][2:] == ("com/de/", "block")
    assert by[6][:3] == ("net.example.net", "", None) and by[7][:3] == by[8][:3] == by[9][:3] == ("", "", None) and by[10][1:3] == ("", None)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    all_ = urls.judge_urls(pages).collect()
    assert len(all_) == pages.count() and {r.verdict for r in all_} == {"allow", "block"}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def lexical_features(url):
    """The features of a URL and its suffix and ending, plainly computed."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    n = len(url)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    query = re.search(r"\?([^#]*)", url)
    ending = re.search(r"\.([A-Za-z0-9]+)\Z", path)
    m = query[1].count("&") + 1 if query and query[1] else 0
    return (n, len(host), path.count("/"), 1000 * sum(c in "0123456789" for c in url) // max(n, 1), round(entropy * 1000), m, host.count("-"), host.count(".") + 1), host.rsplit(".", 1)[-1], ending[1] if ending else ""


def test_url_features_and_scores_against_plain_ones(spark):
    """The whole URL counts, of any length, and every suffix and ending of the sample."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh-0123456789") for _ in range(r.randint(1, n)))
    made = []
    for k in range(500):
        host = r.choice(["", "www.", "a-b."]) + word(8) + "." + r.choice(["org", "net", "com", "example.org", word(30)])
        made.append(f"https://{host}/{r.choice(['en', 'fr', 'de', 'es'])}/{word(9)}{r.choice(['', '.html', '.' + word(20)])}{r.choice(['', '?', '?a=1', '?a=1&b=2#x'])}")
    made += ["http://tail.net/" + "a" * 5000 + c for c in ("a" * 3000, "".join(map(chr, range(0x4E00, 0x4E00 + 3000))))] + [None, "", "x", made[0], "a://b.c?x=1?y&z"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    host, path = urls.parts(F.col("url"))
    own = [*urls.FEATURES[:-2], "suffix", "ending"]
    rows = urls.lexical(pages.select("page_id", "url", host.alias("host"), path.alias("path"))).select("page_id", *own).collect()
    hashes = dict(spark.createDataFrame([(x,) for u in made for x in lexical_features(u)[1:]], "x string").select("x", F.xxhash64("x")).distinct().collect())
    for x in rows:
        numbers, suffix, ending = lexical_features(made[x.page_id])
        assert (*x[1:9], x.suffix, x.ending) == (*numbers, hashes[suffix], hashes[ending]), made[x.page_id][:80]
    by = {x.page_id: x for x in rows}
    assert by[500].entropy != by[501].entropy  # they differ only beyond 5,000 signs
    got = urls.judge_urls(pages)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.sql(URL_SQL).fetchall()
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule").collect())) == sorted(want)
    # the trees and rates, walked plainly
    name, given = urls.decide(urls.RULES, F.col("host"), F.col("path"))
    marked = urls.lexical(pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": name, "given": given})).withColumn("label", (F.col("given") == "allow").cast("int"))
    model = urls.train(marked)
    assert model.trees and len(model.rates[1]) > 50  # no longer the 50 commonest only
    for x in got.collect():
        numbers, suffix, ending = lexical_features(made[x.page_id])
        z = [*numbers, *[model.rates[k].get(hashes[h], model.rates[2]) for k, h in enumerate((suffix, ending))]]
        total = model.base
        for node in model.trees:
            while isinstance(node, tuple):
                node = node[2] if z[node[0]] < node[1] else node[3]
            total += node
        assert x.score == pytest.approx(total, abs=2e-6)
        fits = [q for q in urls.RULES if (x.host == q[1] or x.host.endswith("." + q[1])) and x.path.startswith(q[2])]
        assert x.verdict == (max(fits, key=lambda q: len(q[1] + q[2]))[0] if fits else "allow" if x.score >= 0 else "block")


URL_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT page_id, x, regexp_extract(x, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(x, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(host, path) AS (VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/'))
SELECT page_id, host, path, (SELECT arg_max(q.host || q.path, length(q.host || q.path)) FROM rules q WHERE (p.host = q.host OR p.host LIKE '%.' || q.host) AND starts_with(p.path, q.path)) AS rule FROM p
"""


def test_samples_by_hash(spark):
    """What is sorted for a sample doesn't grow with the rows, and the sample is that of the smallest hashes."""
    from tidemark.llm.training import smallest_hashes

    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id").unionByName(spark.range(50_000).select(F.xxhash64(F.lit(7).cast("long")).alias("h"), F.lit(7).cast("long").alias("id")))
    cut = smallest_hashes(rows, "h", 1000)
    assert 1000 <= cut.select("h").distinct().count() < 4000
    least = [x.h for x in rows.select("h").distinct().orderBy("h").limit(1000).collect()]
    assert [x.h for x in cut.select("h").distinct().orderBy("h").limit(1000).collect()] == least
    assert smallest_hashes(rows.limit(0), "h", 10).count() == 0 and smallest_hashes(rows.limit(5), "h", 10).count() == 5


def test_boosted_trees_learn():
    r = random.Random(0)
    x = [[r.randint(0, 100) for _ in urls.FEATURES] for _ in range(600)]
    y = [int(a[0] > 50 and a[3] < 70 or a[5] > 90) for a in x]
    base, trees = urls.boost(x[:400], y[:400])

    def of(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    right = sum((base + sum(of(t, a) for t in trees) >= 0) == (b == 1) for a, b in zip(x[400:], y[400:], strict=True))
    assert right >= 180


def test_mixing(spark):
    r = random.Random(2)
    texts = [(k, "w " * r.randint(0, 60)) for k in range(400)] + [(None, "a"), (None, None), (3, "w w"), (3, "w w")]
    df = spark.createDataFrame([(i, t, "en", "hot" if k % 10 else r.choice(["a", "b", None]), 1, "x", 1, 1, 1) for k, (i, t) in enumerate(texts)], SCHEMA)
    got = mixing.mix_sources(df, target_entropy=0.99, max_repeats=3.0).collect()
    assert len(got) == len(texts) and all(x.n_copies >= 1 for x in got)
    total = {}
    for x in got:
        a = total.setdefault(x.source, [0, 0])
        a[0] += x.n_tokens
        a[1] += x.n_tokens * x.n_copies
    assert total["hot"][0] == total["hot"][1]
    assert max(b / a for a, b in total.values()) <= 3.0 + 0.01
    shares = [a for a, _ in total.values()]
    assert mixing.entropy([s / sum(shares) for s in shares], mixing.find_exponent([s / sum(shares) for s in shares], 0.9, None)) == pytest.approx(0.9)
    small = mixing.mix_sources(df, target_entropy=None, max_repeats=None, budget=1000).collect()
    assert 900 < sum(x.n_tokens * x.n_copies for x in small) <= 1003
    assert mixing.mixed(df, max_repeats=3.0, target_entropy=0.99).count() == sum(x.n_copies for x in got)
    assert mixing.mixed(df).columns == df.columns and mixing.mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", registry.ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr) == sorted(con.sql(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall(), key=repr)


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for classify, label, least in ((classify_quality, "quality", 0.95), (classify_toxicity, "toxic", 0.85)):
        got = classify(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][label] for r in held) >= least * len(held)
    odd = frame(spark, ODD)
    for classify in (classify_quality, classify_toxicity):
        assert classify(odd, labels.limit(0)).count() == len(ODD)
        assert classify(odd.limit(0), labels).count() == 0
        assert classify(odd, spark.sql("select 5L doc_id, null quality, cast(null as int) toxic")).count() == len(ODD)


def test_best_threshold():
    import numpy as np

    assert -1 < best_threshold(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])) < 1
    assert best_threshold(np.array([1.0, 2.0]), np.array([1, 1])) == 0.0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = docs.first().text
    more = [(10_001, text, "en", "s", 1), (10_002, text, "en", "s", 1), (10_003, text + "\ntoken=abcdefghijklmnop", "en", "s", 1), (None, "Nobody knows the number of this one.", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame([*more, more[-1]], docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == before.columns
        if name == "quality classifier":
            truth = {r.doc_id: r.quality for r in labels.collect()}
            gone = {r.doc_id for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            assert gone and sum(truth.get(i, 0) for i in gone) <= 0.05 * len(gone)
        if name == "simhash near-dedup":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and not {10_001, 10_002} & set(ids)
        if name == "secret scan":
            assert docs.count() == before.count() and docs.filter("text like '%[SECRET]%'").count() > 0
            assert secrets.report(docs).filter("n_assign + n_access + n_hex > 0").count() == 0
        if name == "source mixing":
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert docs.filter("offset <> 0 or length > 1024").count() == 0


def test_identifiers_in_quotes_and_capitals(spark):
    from tidemark.llm.secrets import KINDS, scan

    late = "Ab" * 60 + "7"  # its first digit comes after 120 signs
    heads = ['"client_id": "abc"', 'client_id = "abc"', "CLIENT_ID=abc", "USERNAME=bob"]
    rows = [(k, f"{head} x {late}") for k, head in enumerate(heads)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all([KINDS[x.kind] for x in r.spans] == ["client", "value"] for r in got)
