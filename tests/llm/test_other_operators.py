"""Vectors, pages, the pipeline and the subpackage's place in the library."""

import os
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fixtures import AWKWARD, documents
from fleetstat.llm import neighbours, queries, wrappers

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute_links(rows, threshold=0.93):
    good = [(k, np.array(v, dtype=float)) for k, (_, v, label) in enumerate(rows)
            if label is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and rows[a][2] == rows[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, near in links.items():
            for b in near:
                if group[b] < group[a]:
                    group[a], changed = group[b], True
    ids = {}
    for k, g in enumerate(group):
        ids.setdefault(g, []).append(rows[k][0])
    least = {g: min((i for i in x if i is not None), default=None) for g, x in ids.items()}
    return Counter((rows[k][0], len(links[k]), least[group[k]]) for k in range(len(rows)))


def vectors(seed=3):
    rng, rows, n = np.random.default_rng(seed), [], 0
    for label in range(3):
        for size in (40, 12, 3, 1, 1, 1, 1):
            centre = rng.standard_normal(16)
            for _ in range(size):
                rows.append((n, (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                n += 1
    some = rows[5][1]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(n + k, v, 0) for k, v in enumerate(bad)]
    rows += [(n + 20, some, 0), (n + 21, some, None), (n + 20, some, 0), (None, some, 0), (n + 22, some[:8], 0), (n + 23, [2 * x for x in some], 0)]
    return rows


def test_vector_links(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, v int, near string").repartition(3)
    got = neighbours.linked(df, k=4).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert neighbours.linked(df.limit(0)).count() == 0


def test_audit_measures_what_is_missing(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    _, points = neighbours.vertices(df, "vec_id", "embedding", "label")
    graph = neighbours.descend(points, k=6, leaves=2, rounds=3)
    degrees = neighbours._degrees(neighbours._joined(points, graph, 0.93), 0.93)
    assert neighbours.audit(points, degrees) == 1.0
    assert neighbours.audit(points, degrees.limit(0)) == 0.0


def crowds(cosine, bridges, seed=5, size=700, dim=32):
    """Two crowds of near copies, all links across or only those of `bridges` pairs."""
    rng, out = np.random.default_rng(seed), []
    angle = np.arccos(cosine)
    for side in (0, 1):
        for k in range(size):
            turn = side * angle + (0.075 if side == 0 else -0.075) * (k < bridges)
            x = 0.01 * rng.standard_normal(dim)
            x[:2] += np.cos(turn), np.sin(turn)
            out.append((len(out), x.astype(np.float32).tolist(), 0))
    return out


@pytest.mark.parametrize("cosine, bridges", [(0.95, 0), (0.88, 2)])
def test_links_between_crowds_are_found(spark, monkeypatch, cosine, bridges):
    """Lists are full of vectors of the own crowd; the links across must join the two nevertheless."""
    monkeypatch.setattr(neighbours, "AUDIT", 1)
    rows = crowds(cosine, bridges)
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    across = int(near[:700, 700:].sum())
    assert near[:700, :700].sum() == 700 * 699 and across and (not bridges or across < 20)
    got = neighbours.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(axis=1).tolist()))
    assert {r.component_id for r in got} == {0}


def test_audit_counts_links_between_components(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    _, points = neighbours.vertices(df, "vec_id", "embedding", "label")
    alone = points.withColumn("component", points["v"])
    degrees = neighbours._degrees(alone, 0.93)
    recall, apart = neighbours.audited(alone, degrees)
    assert recall == 0.0 and apart > 1000


def test_rare_links_are_audited_and_compared_if_not_found(spark, monkeypatch):
    """A search that finds nothing fails the audit although the first sample has no true link; then all pairs are compared."""
    rng = np.random.default_rng(11)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(rng.standard_normal((3000, 16)).astype(np.float32))]
    rows += [(3000 + k, rows[k][1][:15] + [rows[k][1][15] + 0.01], 0) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    _, points = neighbours.vertices(df, "vec_id", "embedding", "label")
    alone = points.withColumn("component", points["v"])
    assert neighbours.audited(alone, neighbours._degrees(alone, 0.93), queries=10) == (0.0, sum(n for _, n, _ in brute_links(rows[:6] + rows[3000:]).elements()))
    monkeypatch.setattr(neighbours, "TRIES", 0)
    got = neighbours.linked(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.n_links) == Counter(
        (k, n, g) for k, n, g in brute_links(rows[:6] + rows[3000:]).elements() if n)


def test_labels_with_more_vectors_have_more_trees(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(0,), (3,), (10,), (17,)], "bits int").select("bits", neighbours._trees(4, F.col("bits"), 0.93).alias("trees"))
    for bits, trees in df.collect():
        assert trees >= 4 and (bits == 0 or (1 - 0.8802 ** bits) ** trees <= 0.0101)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><nav><ul><li>m<li>n</ul></nav>
<header><p>site</header><div class="ad">buy</div><article><h1>A &amp; B&nbsp;</h1><p>one <b>two</b>three<br>four
 five<p>six <!-- no --><script>var a="</p>";</script><div class="share-box">share</div>%s</article><aside>side</aside>
<section class="comments"><article><p>reader says</article></section><form><p>mail</form><div id="cookie-notice">ok</div><footer>end</footer></body>"""


def test_main_text_of_hand_pages(spark):
    rows = [(1, "http://a.example/1", PAGE % ""), (2, "http://a.example/2", PAGE % "<ul><li>x</li><li>y<li>z</ul>"), (2, "http://a.example/2", PAGE % "<ul><li>x</li><li>y<li>z</ul>"),
            (3, None, None), (4, "http://[bad", ""), (5, "http://b.example/", "<div class=menu>m</div><div class=main><p>alpha beta gamma delta</p><p>2 < 3</div><div class=sidebar>s"),
            (6, "http://c.example/", "plain &lt;text&gt; only"), (None, "http://a.example/3", "<article><p>" + "long " * 5000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, content int")
    got = wrappers.report(wrappers.extract(df)).collect()
    body = "A & B\n\none twothree four five\n\nsix"
    assert Counter((r.page_id, r.text) for r in got) == Counter([
        (1, body), (2, body + "\n\nx\n\ny\n\nz"), (2, body + "\n\nx\n\ny\n\nz"), (3, ""), (4, ""), (5, "alpha beta gamma delta\n\n2 < 3"), (6, "plain <text> only"), (None, ("long " * 5000).strip())])
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_pages_of_a_minority_layout_keep_their_text(spark):
    story, entry = "<body><div class=top><p>top</div><div class=story><p>%s</div>", "<body><div class=top><p>top</div><div class=entry><p>%s</div>"
    rows = [(k, "http://a.example/", (story if k < 7 else entry) % (f"{k} tale " * 30)) for k in range(10)]
    rows += [(10 + k, "http://b.example/", f"<article><p>in {k}" if k < 3 else f"<div class=post><p>out {k}</div>") for k in range(4)]
    rows += [(20, None, "<article><p>one"), (21, "http://[bad", "<div><p>two</div>"), (22, None, "<main><p>three</main>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith(f"{k} tale") and "top" not in got[k].split() for k in range(10)), got
    assert [got[k] for k in (10, 11, 12, 13, 20, 21, 22)] == ["in 0", "in 1", "in 2", "out 3", "one", "two", "three"]


@pytest.mark.parametrize("tag, attributes, skipped", [
    ("div", ' style="overflow:hidden"', False), ("div", ' aria-hidden="false"', False), ("p", ' title="the hidden city"', False), ("div", ' data-hidden="1"', False),
    ("div", " hidden", True), ("div", ' hidden=""', True), ("div", ' aria-hidden="true"', True),
    ("body", ' class="no-sidebar"', False), ("div", ' id="content-with-sidebar"', False), ("article", ' class="widget-news"', False), ("main", ' class="search"', False),
    ("div", ' class="article-header"', False), ("div", ' class="x share-box"', True), ("div", ' id="cookie-notice"', True), ("div", ' class="site-footer"', True), ("div", ' class="ad-728x90"', True)])
def test_only_whole_names_rule_parts_out(tag, attributes, skipped):
    assert wrappers._signature(tag, attributes)[1] == skipped


def test_wrappers_have_optional_and_repeated_groups():
    wrapper = wrappers.infer(["<u <l # >l >u <p # >p", "<u <l # >l <l # >l <l # >l >u <h # >h <p # >p <p # >p"])
    assert wrapper == "<u ( <l # >l )+ >u ( <h # >h )? ( <p # >p )+"
    assert wrappers.infer([wrapper, "<u >u <p # >p"]) == "<u ( ( <l # >l )+ )? >u ( <h # >h )? ( <p # >p )+"
    assert wrappers.read_back(wrapper) == wrappers.read_back(wrappers.written_out(wrappers.read_back(wrapper)))


def test_pages_equal_the_article_cut_by_hand(spark):
    import html
    got = {r.page_id: r.text for r in queries.op9_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = documents(spark).selectExpr("doc_id + 10000 AS doc_id", "text", "'en' lang", "source", "cast(length(text) as long) n_chars").unionByName(spark.read.parquet(f"{SF}/documents.parquet")), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out.append((name, docs, docs := spark.read.parquet(f"{folder}/{name}")))
    return out


def test_stages_pass_documents_on(stages):
    assert [n for n, _, _ in stages] == ["language_id", "exact_dedup", "minhash_near_dedup", "secret_scans", "best_fit_packing"]
    for _, _, after in stages[:-1]:
        assert tuple(after.columns) == corpus_pipeline.COLUMNS


def test_stages_decide_as_brute_force_does(stages):
    from test_text_operators import base_spans, brute_classes, brute_near
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    _, before, after = stages[0]
    assert Counter(rows(after)) == Counter((i, t) for i, t in rows(before) if t and re.search(r"[^\W\d_]", t))
    _, before, after = stages[1]
    assert len(rows(after)) == len({k[3] for k in brute_classes(rows(before))})
    assert {k[1] for k in brute_classes(rows(before))} == {i for i, _ in rows(after)}
    _, before, after = stages[2]
    assert Counter(i for i, _ in rows(after)) == Counter(i for i in {k[2] for k in brute_near(rows(before), 5, 80)})
    _, before, after = stages[3]
    assert Counter(i for i, _ in rows(before)) == Counter(i for i, _ in rows(after))
    changed = {i for i, t in rows(before) if base_spans(t)}
    old, new = dict(rows(before)), dict(rows(after))
    assert all(not base_spans(t) for t in new.values()) and all(old[i] == new[i] for i in old if i not in changed and "[secret]" not in new[i])
    _, before, after = stages[4]
    assert {r.doc_id for r in after.collect()} == {i for i, _ in rows(before)}


def test_the_library_does_not_need_the_subpackage(tmp_path):
    """A copy without the two folders and the pipeline still imports and has its reports."""
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "fleetstat", ".git"):
            os.symlink(os.path.join(ROOT, name), tmp_path / name)
    os.mkdir(tmp_path / "fleetstat")
    for name in os.listdir(os.path.join(ROOT, "fleetstat")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "fleetstat", name), tmp_path / "fleetstat" / name)
    with open(os.path.join(ROOT, "__spark_entry__.py")) as f:
        source = f.read().replace("os.path.dirname(os.path.abspath(__file__))", repr(str(tmp_path)))
    os.remove(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(source)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and 'pipeline' not in q and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_all_queries_are_registered():
    assert {n.split("_")[0] for n in queries.queries()} == {"pipeline", *(f"op{n}" for n in range(1, 11))}
    assert len(AWKWARD) == 14
