"""Text functions on hand-made notes."""

import pytest
from pyspark.sql import functions as F

from noteweave.functions import text as tx
from noteweave.operators import notes as nt
from noteweave.operators import rank

NOTE = "---\ntags: [Alpha, beta]\nproject: X\n---\n# Title\n\nFirst line here\r\n- [ ] open task\n* [x] done task\n[[A/b c#h|t]] [[Folder/Other]]\n## Mentions\n- [[n/one|One]] — because\n- [[n/two|Two]]\n## Next\n- [[n/three|Three]]"


def one(spark, column, text=NOTE, path="a/My Note.md"):
    return spark.createDataFrame([(path, text)], "path string, text string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: tx.tokenize(F.lit("Ab-c1 É x")), ["ab", "c1", "x"]),
        (lambda: tx.stem(F.col("path")), "My Note"),
        (lambda: tx.suffix_stem(F.lit("Topics/Node.js")), "Node"),
        (lambda: tx.front_list(F.col("text"), "tags"), ["Alpha", "beta"]),
        (lambda: tx.front_list(F.col("text"), "nothing"), []),
        (lambda: tx.heading(F.col("text"), F.col("path")), "Title"),
        (lambda: tx.excerpt(F.col("text"), F.col("path"), "MY NOTE"), "(title match)"),
        (lambda: tx.excerpt(F.col("text"), F.col("path"), "line"), "First line here"),
        (lambda: tx.excerpt(F.col("text"), F.col("path"), "absent"), "# Title"),
        (lambda: tx.wikilinks(F.col("text")), ["b c", "other", "one", "two", "three"]),
        (lambda: tx.section_lines(F.col("text"), "## Mentions"), ["- [[n/one|One]] — because", "- [[n/two|Two]]"]),
        (lambda: tx.section_lines(F.col("text"), "## Nowhere"), []),
        (lambda: F.array_join(F.transform(tx.section_lines(F.col("text"), "## Mentions"), lambda x: F.concat_ws("/", tx.mention_line(x)["target"], tx.mention_line(x)["evidence"])), ";"), "n/one/because;n/two/"),
        (lambda: tx.relation_line(F.lit("- uses [[a/b|B]]"))["rel"], "uses"),
        (lambda: tx.relink(F.lit("[[a/b]] [[a/b|x]] [[a/bc]]"), "a/b", "z/$1"), "[[z/$1]] [[z/$1|x]] [[a/bc]]"),
        (lambda: tx.norm(F.lit("  A \n b ")), "a b"),
        (lambda: tx.safe_name(F.lit('a:b/"c" ')), "abc"),
        (lambda: tx.safe_name(F.lit("???")), "untitled"),
        (lambda: tx.normalize_link(F.lit(" HTTPS://Ex.com/a/?b=2&utm_x=1&a=&ref=q#frag")), "https://ex.com/a?a=&b=2"),
        (lambda: tx.normalize_link(F.lit("http://e.com")), "http://e.com/"),
        (lambda: tx.lines(F.lit("a\r\nb c\n")), ["a", "b", "c"]),
        (lambda: tx.last_error(F.lit("ok\nfatal: no\nerror two\nend")), "error two"),
    ],
)
def test_columns(spark, column, want):
    assert one(spark, column()) == want


def test_body_without_a_closing_fence(spark):
    assert one(spark, tx.body(F.col("text")), "---\nopen") == "---\nopen" and one(spark, tx.body(F.col("text"))).startswith("\n# Title")


def test_note_queries(spark):
    notes = spark.createDataFrame([("a/My Note.md", NOTE), ("b/other.md", "plain"), ("a b.md", "[[My Note]]")], "path string, text string")
    assert [r.task for r in nt.list_tasks(notes).collect()] == ["open task", "done task"] and nt.list_tasks(notes, open_only=True).count() == 1
    assert [r.path for r in nt.with_tags(notes, ["ALPHA", "Beta"]).collect()] == ["a/My Note.md"] and nt.with_tags(notes, ["gamma"]).count() == 0
    assert [r.path for r in nt.query_notes(notes).collect()] == ["a/My Note.md"]
    assert [r.path for r in nt.backlinks(notes, "x/My Note.md").collect()] == ["a b.md"]
    assert nt.in_folder(notes, "a").count() == 1


def test_bm25l_properties(spark):
    notes = spark.createDataFrame([("a.md", "red fish"), ("b.md", "red red fish fish blue"), ("c.md", ""), ("d.md", "nothing")], "path string, text string")
    got = rank.bm25l(notes, "red").collect()
    assert {r.path for r in got} == {"a.md", "b.md"} and all(r.score > 0 for r in got) and [r["rank"] for r in got] == [1, 2]
    twice = {r.path: r.score for r in rank.bm25l(notes, "red red").collect()}
    assert all(abs(twice[r.path] - 2 * r.score) < 1e-9 for r in got)
    assert rank.bm25l(notes, "absent").count() == 0 and rank.bm25l(notes, "").count() == 0


def test_fusion_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "path string, rank int")
    b = spark.createDataFrame([("z", 1), ("y", 2)], "path string, rank int")
    assert [r.path for r in rank.ranked(rank.rrf([a, b]), rank.rrf_order(), 5).collect()] == ["y", "x", "z"]
