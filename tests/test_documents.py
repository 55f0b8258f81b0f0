"""Documents of blocks, and files that tasks write."""

import glob
import hashlib

from pyspark.sql import functions as F

from lodestrata.sources import documents as D


def made(spark):
    titles = spark.createDataFrame([("a", "A & <b>", "1_2"), ("none", "N", None)], "repo_id string, title string, subtitle string")
    rows = spark.createDataFrame([("a", 3, None, "|x|"), ("a", 1, "p\r\nq", ""), ("a", 2, "<i>", "k"), ("lost", 1, "z", "z")], "repo_id string, n int, s string, t string")
    repos = titles.select("repo_id").filter("repo_id = 'a'")
    parts = [D.heading(repos, 1, "H#", 3), D.said(repos, 2, "say `x`"), D.said(repos, 3, F.lit(None).cast("string")), D.said(repos, 4, "it's", "note"), D.bullets(repos, 5, F.lit("one"), F.lit(None).cast("string"), F.lit("[two]")), D.bullets(repos, 6, F.lit(None).cast("string")), D.listing(rows, 7, {"S": F.col("s"), "T": F.col("t")}, [F.desc("n")], 2, ["T"])]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return titles, every


def test_markdown_and_html(spark):
    got = {r.repo_id: r.body for r in D.documents(*made(spark)).collect()}
    assert got == {
        "a": "# A & \\<b\\>\n\n_1\\_2_\n\n### H\\#\n\nsay \\`x\\`\n\n> it's\n\n- one\n- \\[two\\]\n\n| S | T |\n| --- | ---: |\n|   | \\|x\\| |\n| \\<i\\> | k |\n",
        "none": "# N\n\n__\n",
    }
    page = {r.repo_id: r.body for r in D.documents(*made(spark), "html").collect()}["a"]
    assert "<h3>H#</h3>\n<p>say `x`</p>\n<p class=\"note\">it&#39;s</p>\n<ul><li>one</li><li>[two]</li></ul>\n<table><thead><tr><th>S</th><th class=\"num\">T</th></tr></thead><tbody><tr><td></td><td class=\"num\">|x|</td></tr><tr><td>&lt;i&gt;</td><td class=\"num\">k</td></tr></tbody></table>\n</body></html>\n" in page
    assert "<h1>A &amp; &lt;b&gt;</h1>" in page and "<script" not in page
    assert D.documents(made(spark)[0].limit(0), made(spark)[1]).count() == 0


def test_files_are_the_same_after_a_rerun(spark, tmp_path):
    bodies = {f"report-{i}.md": f"# {i}\r\n\nläßt\n\n" if i % 2 else "" for i in range(40)}
    named = spark.createDataFrame(list(bodies.items()), "name string, body string").repartition(5)
    sums = []
    for order in ("name", "body"):
        D.write_documents(named.orderBy(order), str(tmp_path / "out"))
        files = glob.glob(str(tmp_path / "out" / "name=*" / "part-*"))
        sums.append({f.split("name=")[1].split("/")[0]: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in files})
        assert len(files) == len(sums[-1]) == 40
    assert sums[0] == sums[1]
    assert {r.name: r.body for r in D.read_documents(spark, str(tmp_path / "out")).collect()} == {n: b or "\n" for n, b in bodies.items()}


def test_file_names(spark):
    name = lambda full, form: spark.range(1).select(D.file_name(F.lit(full), F.lit("0123456789"), form)).first()[0]
    assert name("o/n.x", "markdown") == "report-o-n.x-0123456.md" and name("../a b/ü", "html") == "report-..-a-b--0123456.html"
