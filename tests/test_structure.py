"""The Markdown tree, inclusion by policy, containment of spans and the node graph."""

import random

import pytest
from penstroke.operators import corpus, ingest, structure
from pyspark.sql import functions as F


def shown(text):
    """(role, containers below the document, exclusion, raw text) of each leaf."""
    return [(x.role, x.containers[1:], x.exclusion, text[x.start : x.end]) for x in structure.leaves(text)]


def one(text, role):
    (leaf,) = [x for x in structure.leaves(text) if x.role == role]
    return leaf


def test_quotes_and_lists_nest_both_ways():
    text = "> - Someone said this in a whole sentence.\n"
    assert shown(text) == [("paragraph", ("block-quote", "list", "list-item"), "excluded-by-block-quote-policy", "Someone said this in a whole sentence.")]
    text = "1. The item begins with a whole sentence.\n\n   > And it goes on with a quote.\n2. next\n"
    assert [x[:3] for x in shown(text)] == [("paragraph", ("list", "list-item"), ""), ("paragraph", ("list", "list-item", "block-quote"), "excluded-by-block-quote-policy"), ("paragraph", ("list", "list-item"), "excluded-not-sentential")]


def test_definitions_and_footnotes():
    text = "Word\nOther word\n: What both of them mean, in a sentence.\n: Another meaning\n  of it is given here.\n\nLast\n\n: Its meaning.\n\nThis is claimed.[^a] And this.[^b]\n\n[^a]: Said elsewhere in a longer text.\n\n    With a second paragraph.\n[^never]: Nothing refers to this note.\n"
    got = shown(text)
    assert [x[0] for x in got] == ["definition-term", "definition-term", "definition-description", "definition-description", "definition-term", "definition-description", "paragraph", "footnote", "footnote"]
    assert {x[1] for x in got[:6]} == {("definition-list",)} and {x[1] for x in got[7:]} == {("footnote-section", "footnote")} and got[2][2] == "" and got[0][2] == "excluded-by-role"
    leaves = structure.leaves(text)
    assert len({x.path[1] for x in leaves[:6]}) == 1  # one list for terms that follow each other
    assert structure.run_text(text, leaves[6]) == "This is claimed. And this.[^b]"


def test_zero_words_outrank_the_quote_policy():
    for quotes in (False, True):
        (leaf,) = structure.leaves("> `code and nothing else`\n", quotes)
        assert (leaf.words, leaf.exclusion) == (0, "excluded-not-sentential")
    assert one("> Words of another.\n", "paragraph").exclusion == "excluded-by-block-quote-policy" and structure.leaves("> Words of another.\n", True)[0].exclusion == ""


@pytest.mark.parametrize("mark", ["![a](x.png)", "![](x.png)", '![a](x.png "t")', "![a][r]", "![R][]", "![r]"])
def test_images_are_excised_if_they_resolve(mark):
    text = f"See {mark} here now.\n\n[r]: /address\n"
    leaf = one(text, "paragraph")
    assert structure.run_text(text, leaf) == "See  here now." and leaf.words == 3
    assert one(f"{mark}{mark}\n\n[r]: /address\n", "image").exclusion == "excluded-by-role"


def test_what_does_not_resolve_stays():
    text = "A `` tick, ![x][none] and [^ none] stay \\`as they are`.\n"
    assert one(text, "paragraph").excisions == []
    assert one("`code with ![](i.png) inside`\n", "paragraph").words == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("```\n```\n", []), ("#\n", []), ("|a||\n|-|-|\n|b|c|\n", ["table-cell"] * 3), ("Said before.\na|b\n-|-\n", ["paragraph", "table-cell", "table-cell"]), ("", []), ("\n \n", []),
        ("<script>\nx = '<p>';\n\ny\n</script>\nAfter it.\n", ["html-block", "paragraph"]), ("<div>\na\n\nb\n", ["html-block", "paragraph"]), ("text\n<b>x</b>\n", ["paragraph"]), ("    code\n\n    more\ntext\n", ["code-block", "paragraph"]),
        ("Title\n===\nsub\n---\n", ["heading", "heading"]), ("a\n***\nb\n", ["paragraph", "paragraph"]), ("<figure>\n<figcaption></figcaption>\n</figure>\n", ["html-block", "html-block"]), ("~~~ x\ny\n", ["code-block"]),
    ],
)
def test_blocks(text, want):
    assert [x.role for x in structure.leaves(text)] == want


def test_spans_keep_to_graphemes_and_lines_lose_their_prefix():
    text = "# ́a\r\n\r\n> One line `of\r\n> code` goes on\r\n>   and on.\r\n"
    heading, quote = structure.leaves(text)
    assert text[heading.start : heading.end] == " ́a"  # the mark stands on the space before it
    assert structure.run_text(text, quote) == "One line  goes on\r\nand on." and not text[quote.start : quote.end].endswith("\r")


def test_any_text_parses_and_leaves_are_apart():
    r, parts = random.Random(3), ["> ", "- ", "1. ", "\n", "\n\n", "    ", "```", "word ", "`", "![a](b)", "|", "---", ": x", "[^1]", "[^1]: ", "<div>", "# ", "\r\n", "\t", "é́", "[r]: /u", "===", "<!--", "-->"]
    for _ in range(600):
        text = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        at = 0
        for x in structure.leaves(text):
            assert at <= x.start < x.end <= len(text) and all(x.start <= a < b <= x.end for a, b in x.excisions)
            at = x.end
    assert len(structure.leaves(">" * 5000 + " deep")) == 1 and structure.leaves("- " * 3000 + "x")


DOCS = "doc_id long, text string, source string"


def test_nodes_enclose_their_children(spark):
    text = "é. First.\n\n> - Ä quoted item.\n>\n> More.\n\nClaim.[^1]\n\n[^1]: Note.\n"
    docs = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", "s")], DOCS)
    nodes = structure.nodes(docs, structure.document_leaves(docs)).cache()
    raw = text.encode()
    rows = [r for r in nodes.collect() if r["doc_id"] == 1]
    spans = {(r["kind"], r["name"]): raw[r["start"] : r["start"] + r["length"]].decode() for r in rows if r["name"] != "paragraph"}
    assert spans["container", "document"] == text and spans["container", "block-quote"] == "Ä quoted item.\n>\n> More." and spans["container", "list"] == "Ä quoted item." and spans["leaf", "footnote"] == spans["container", "footnote-section"] == "Note."
    assert {(r["doc_id"], r["nodes"], r["reached"], r["outside"]) for r in structure.enclosure(nodes).collect()} == {(1, len(rows), len(rows), 0), (2, 1, 1, 0), (3, 1, 1, 0)}
    broken = nodes.withColumn("parent", F.when(F.col("name") == "list", 77).otherwise(F.col("parent"))).withColumn("length", F.when(F.col("name") == "footnote-section", 1).otherwise(F.col("length")))
    (bad,) = [r for r in structure.enclosure(broken).collect() if r["doc_id"] == 1]
    assert bad["outside"] == 2 and bad["reached"] == len(rows) - 3  # the list, its item and the leaf in it


def test_policies_change_without_parsing(spark):
    text = "- Ship it now.\n- Every rule declares its provenance here\n\n> A quoted sentence is not mine.\n"
    leaves = structure.parsed(spark.createDataFrame([(1, text, "s")], DOCS)).cache()

    def included(**policy):
        return [r["exclusion"] for r in structure.classified(leaves, **policy).orderBy("ordinal").collect()]

    assert included() == ["excluded-not-sentential", "excluded-not-sentential", "excluded-by-block-quote-policy"]
    assert included(min_sentential=3) == ["", "excluded-not-sentential", "excluded-by-block-quote-policy"]
    assert included(min_unpunctuated=6, quotes_included=True) == ["excluded-not-sentential", "", ""]
    again = structure.classified(structure.classified(leaves, quotes_included=True))
    assert [r["exclusion"] for r in again.orderBy("ordinal").collect()] == included()


def test_the_one_candidate_that_contains(spark):
    r = random.Random(4)
    spans = [(k, i, a, a + r.randrange(1, 9)) for k in range(3) for i in range(60) for a in [r.randrange(200)]]
    held = [(k, i, a, a + r.choice([0, 1, 5, 12, 40, 300])) for k in range(2) for i in range(40) for a in [r.randrange(200)]]
    kind = "k long, id long, start long, end long"
    got = {(x["k"], x["id"]): x["candidate"] for x in structure.uniquely_contained(spark.createDataFrame(spans, kind), spark.createDataFrame(held, kind), "k").collect()}
    for k, i, a, b in spans:
        inside = [j for q, j, s, e in held if q == k and s < a and b < e]
        assert got[k, i] == (inside[0] if len(inside) == 1 else None)
    assert len({v is None for v in got.values()}) == 2
    none = structure.uniquely_contained(spark.createDataFrame(spans, kind), spark.createDataFrame([], kind), "k")
    assert none.where("candidate is null").count() == len(spans)


def test_ingest_keeps_rejected_documents(spark):
    text = "# Head\n\nThe first paragraph of this document has many more than ten words in it.\n\nShort one.\n"
    docs = spark.createDataFrame([(1, "a", text, "s"), (2, "b", text, "s"), (3, "c", "...", "s")], "doc_id long, path string, text string, source string")
    admitted = corpus.admitted(docs)
    for segmenter, nodes, vectors in (("markdown", ["heading", "paragraph", "paragraph"], 1), ("line", ["paragraph"] * 6, 1)):
        g = ingest.ingest(admitted, "snap", segmenter)
        assert {r["path"]: r["admission"] for r in g.documents.collect()} == {"a": "eligible", "b": "rejected-duplicate", "c": "rejected-too-short"}
        own = g.nodes.orderBy("ordinal").collect()
        assert [r["role"] for r in own] == nodes and [r["ordinal"] for r in own] == list(range(len(nodes))) and {r["doc_id"] for r in own} == {1}
        assert all(text.encode()[r["start"] : r["start"] + r["length"]].decode() in text for r in own)
        (v,) = g.vectors.collect()
        assert v["lexical"] == 14 and v["node_id"] in {r["node_id"] for r in own} and g.vectors.count() == vectors
    with pytest.raises(ValueError):
        ingest.ingest(admitted, "snap", "word")


def test_ids_of_many_digits_keep_their_duplicates_apart(spark):
    docs = spark.createDataFrame([(10**12 + 1, "same words", "s"), (10**12 + 2, "same words", "s"), (7, "same words", "s")], DOCS)
    assert {r["doc_id"]: r["admission"] for r in corpus.admitted(corpus.from_documents(docs)).collect()} == {7: "eligible", 10**12 + 1: "rejected-duplicate", 10**12 + 2: "rejected-duplicate"}
