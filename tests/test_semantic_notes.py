"""References as tokens, definitions beside their notes, counts against a contract; keywords of either script."""

from pyspark.sql import functions as F

from quillspark.operators.semantic_notes import rewritten
from quillspark.operators.text_metrics import theme_keywords


def test_rewriting(spark):
    texts = {
        1: ["a[^x] b[^y] c[^x]", "[^x]: first", "    more", "", "\tlast", "after[^q]", "[^y]: [^x] inside", "plain"],
        2: ["only[^x]", "  [^x]:  body  ", "", "not indented"],
        3: ["x[^x][^x][^x]", "no definition"],
        4: ["nothing"],
    }
    lines = spark.createDataFrame([(d, i, l) for d, ls in texts.items() for i, l in enumerate(ls, 1)], "doc_id long, line_no long, line string").repartition(3)
    notes = spark.createDataFrame([(1, "n1", "x", 1, 2), (1, "n2", "y", 2, 1), (2, "m1", "x", 1, 2), (3, "k1", "x", 1, 2), (4, "z", "x", 1, 0)], "doc_id long, id string, label string, marker int, refs int")
    left, said = rewritten(lines, notes)
    out: dict = {}
    for r in left.orderBy("doc_id", "line_no").collect():
        out.setdefault(r["doc_id"], []).append(r["line"])
    t = lambda n, k, m: f"@@NOTEREF__{n}__{k}__{m}@@"
    assert out == {
        1: [f"a{t('n1', 1, 1)} b{t('n2', 1, 2)} c{t('n1', 2, 1)}", "after[^q]", "plain"],
        2: [f"only{t('m1', 1, 1)}", "", "not indented"],
        3: [f"x{t('k1', 1, 1)}{t('k1', 2, 1)}[^x]", "no definition"],
        4: ["nothing"],
    }
    assert {(r["doc_id"], r["id"]): (r["finding"], r["definition"]) for r in said.collect()} == {
        (1, "n1"): (None, "first\nmore\n\nlast"), (1, "n2"): (None, "[^x] inside"), (2, "m1"): ("fewer_references", "body"), (3, "k1"): ("more_references", None), (4, "z"): ("no_definition", None),
    }


def test_theme_keywords(spark):
    rows = [("这是 主要内容 知识图谱 and this Section about Graph-theory, graph-theory Graph-theory 图",), ("a bc def 1234",), ("",), (None,), ("That THIS with",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(theme_keywords(F.col("t"))).collect()]
    assert out == [["主要内容", "知识图谱", "about", "Graph-theory", "graph-theory"], ["核心主题"], ["核心主题"], ["核心主题"], ["核心主题"]]
