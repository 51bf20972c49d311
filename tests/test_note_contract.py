"""Every rule of the contract of notes: one pair that meets them all, and for each rule a change that breaks it."""

from quillspark.operators import note_contract as C
from quillspark.operators.structure import read_lines

TEXT = ["<!-- page: 4 -->", "# One", "text[^a] more", "text[^a] and [^b]", "[^a]: first", "## Two", "[^b]: second", "<!-- page: 5 -->"]
A = {"doc_id": 1, "place": 1, "id": "note_001", "label": "a", "kind": "footnote", "start_line": 5, "end_line": 5, "section_id": "s1", "ref_lines": [3, 4], "ref_ids": ["noteref_note_001_001", "noteref_note_001_002"]}
B = {"doc_id": 1, "place": 2, "id": "note_002", "label": "b", "kind": "footnote", "start_line": 7, "end_line": 8, "section_id": "s2", "ref_lines": [4], "ref_ids": ["noteref_note_002_001"]}
STATED = {"files": ["x.md"], "anchor": "x.xhtml#a", "evidence": ["marker"], "anomalies": []}
SECTIONS = [(1, "s1", 2, 8, 1, "One", False), (1, "s2", 6, 8, 2, "Two", False)]
SOURCES = [(1, "x.md", "x.xhtml", 1, 8, [9]), (1, "y.md", "y.xhtml", 20, 30, [11])]


def run_all(spark, cases, own=SECTIONS, made=SECTIONS, sources=SOURCES, text=TEXT):
    """The findings of each case (contracts, notes), a document each, in one go."""
    ids = range(1, len(cases) + 1)
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) if isinstance(r, dict) else r for r in rows], schema)
    of = lambda k, rows: [r | {"doc_id": k} if isinstance(r, dict) else (k, *r[1:]) for r in rows]
    every = lambda rows: [r for k in ids for r in of(k, rows)]
    lines = read_lines(spark.createDataFrame([(k, text) for k in ids], "doc_id long, lines array<string>"))
    contracts, notes = ([r for k, c in zip(ids, cases, strict=True) for r in of(k, c[side])] for side in (0, 1))
    out = C.findings(frame(contracts, C.CONTRACT), frame(notes, C.NOTE), frame(every(own), C.SECTION), frame(every(made), C.SECTION), frame(every(sources), C.SOURCE), lines).collect()
    return [sorted((r["place"], r["finding"]) for r in out if r["doc_id"] == k) for k in ids]


def run(spark, contracts, notes, **settings):
    return run_all(spark, [(contracts, notes)], **settings)[0]


def stated(**changes):
    return [A | STATED | {"pages": [4]} | changes, B | STATED | {"pages": [4, 5]}]


def test_a_contract_that_holds(spark):
    assert run(spark, stated(), [A, B]) == []


BROKEN = [
    ({"kind": "sidenote"}, {"unsupported_kind", "kind_differs"}), ({"kind": "endnote"}, {"kind_differs"}), ({"id": "note_009"}, {"id_differs", "reference_ids_malformed"}), ({"label": "z"}, {"label_differs", "reference_not_in_text", "definition_not_in_text"}),
    ({"end_line": 6}, {"range_differs"}), ({"start_line": 4}, {"range_differs", "definition_not_in_text"}), ({"end_line": 4}, {"range_differs", "bad_range"}), ({"end_line": 99}, {"range_differs", "bad_range", "outside_of_section", "wrong_section", "files_differ", "pages_differ"}),
    ({"ref_lines": [4, 3]}, {"references_differ", "references_out_of_order"}), ({"ref_lines": [3, 5]}, {"references_differ", "reference_not_in_text"}), ({"ref_lines": [], "ref_ids": []}, {"references_differ", "reference_ids_differ", "no_references"}), ({"ref_ids": ["x", "y"]}, {"reference_ids_malformed", "reference_ids_differ"}),
    ({"anchor": " "}, {"no_anchor"}), ({"anchor": "y.xhtml#q"}, {"files_differ"}), ({"evidence": []}, {"no_evidence"}), ({"anomalies": ["odd"]}, {"has_anomalies"}), ({"pages": [4, 4]}, {"pages_out_of_order", "pages_differ"}), ({"pages": [9]}, {"pages_differ"}),
    ({"section_id": "s7"}, {"unknown_section", "wrong_section"}), ({"section_id": "s2"}, {"outside_of_section", "wrong_section"}), ({"files": []}, {"files_differ"}), ({"files": ["x.md", "x.md"]}, {"files_differ"}), ({"files": ["x.md", "y.md"]}, {"files_differ"}),
]


def test_each_rule_is_broken_by_itself(spark):
    out = run_all(spark, [(stated(**changes), [A, B]) for changes, _ in BROKEN])
    for (changes, found), got in zip(BROKEN, out, strict=True):
        first = {f for p, f in got if p == 1}
        assert found <= first <= found | {"pages_differ"}, changes
    assert {f for _, found in BROKEN for f in found} | {"id_repeats", "label_repeats"} == set(C.RULES)


def test_pairs_and_repeats(spark):
    assert run(spark, stated(), [A]) == [(2, "not_in_text")] and run(spark, stated()[:1], [A, B]) == [(2, "not_extracted")]
    twice = [stated()[0], stated()[0] | {"place": 2}]
    assert {(2, "id_repeats"), (2, "label_repeats")} <= set(run(spark, twice, [A, A | {"place": 2}]))


def test_sections_that_were_corrected(spark):
    """A section that the compiled ones lack is wrong unless the one that owns the note was corrected by hand."""
    moved = [(1, "s1", 2, 8, 1, "Uno", False), SECTIONS[1]]
    assert run(spark, stated(), [A, B], made=moved) == [(1, "wrong_section")]
    assert run(spark, stated(), [A, B], made=[(1, "s1", 2, 8, 1, "Uno", True), SECTIONS[1]]) == []
    assert run(spark, stated(), [A, B], made=[(1, "s1", 2, 8, 1, "  ONE ", False), SECTIONS[1]]) == []


def test_pages_of_the_sources_where_the_text_has_none(spark):
    plain = ["", "# One", *TEXT[2:7], ""]
    assert run(spark, [A | STATED | {"pages": [9]}, B | STATED | {"pages": [9]}], [A, B], text=plain) == []
