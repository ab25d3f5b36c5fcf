"""Outside articles the wrapper of a host decides: text equal on all its pages is template."""

from fleetstat.llm import wrappers

PAGE = "<body><div class=story><p>Read more on this site</p><h2>%s</h2>%s<p>All rights reserved</p></div></body>"


def texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_text_equal_on_all_pages_of_a_host_is_template(spark):
    body = lambda k: "".join(f"<p>{k} tale {i}</p>" for i in range(k % 3 + 1))
    rows = [(k, "http://a.example/", PAGE % (f"head {k}", body(k))) for k in range(8)]
    rows += [(20, "http://few.example/", PAGE % ("x", body(1))), (21, "http://few.example/", PAGE % ("y", body(2)))]
    rows += [(30 + k, "http://same.example/", PAGE % ("copy", body(1))) for k in range(5)]
    rows += [(40 + k, "http://art.example/", f"<article><p>{k}</p><p>Read more on this site</p></article>") for k in range(5)]
    got = texts(spark, rows)
    for k in range(8):
        assert got[k] == "\n\n".join([f"head {k}", *(f"{k} tale {i}" for i in range(k % 3 + 1))])
    assert got[20] == "Read more on this site\n\nx\n\n1 tale 0\n\n1 tale 1\n\nAll rights reserved"  # too few pages to tell
    assert {got[30 + k] for k in range(5)} == {"Read more on this site\n\ncopy\n\n1 tale 0\n\n1 tale 1\n\nAll rights reserved"}  # nothing but template
    assert [got[40 + k] for k in range(5)] == [f"{k}\n\nRead more on this site" for k in range(5)]  # an article is whole


def test_alignment_keeps_equal_texts_and_makes_slots_of_others():
    a, b, x, y = (wrappers.fixed_text("p", t) for t in ("same", "same", "one", "two"))
    assert wrappers.infer([f"<p {a} >p <q {x} >q", f"<p {b} >p <q {y} >q"]) == f"<p {a} >p <q #p >q"
    assert wrappers.template(wrappers.infer([f"<p {a} >p <q {x} >q", "<q #p >q"])) == []
    assert wrappers.template(f"<p {a} >p ( <q {x} >q )+ ( {y} )?") == [a]
