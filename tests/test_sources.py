import gzip
import io
import json
import tarfile

import pytest

from axiomata.operators import sinks
from axiomata.sources import expressions, latex, lean, readers
from axiomata.streaming import incremental


def test_expressions():
    form = lambda t: expressions.canonical(expressions.parse(t)[0])
    assert form("∀ (x : Nat), x = x") == form("∀ (y : Nat), y = y") != form("∀ (y : Nat), y = z")
    assert form("λ x y, x y") == form("fun a b => a b") != form("λ x y, y x")
    shown = lambda t: expressions.display(expressions.parse(t)[0])
    assert shown("a -> b -> c") == "(a → (b → c))" and shown("a - b - c") == "((a - b) - c)" and shown("2 ^ 3 ^ x") == "(2 ^ (3 ^ x))"
    assert shown("f (g x) y ∧ ¬ p") == "(f (g x) y ∧ ¬p)"
    assert expressions.parse("a +")[1] == "partial" and expressions.parse(")")[1] == "failed" and expressions.parse("")[1] == "failed" and expressions.parse(None)[1] == "failed"
    deep = expressions.parse("(" * 3000 + "x" + ")" * 3000)
    assert deep[1] == "full" and expressions.canonical(deep[0]) == "C1:x"
    long, _ = expressions.parse(" + ".join(f"x{k}" for k in range(3000)))
    assert expressions.display(long).startswith("(" * 2999) and expressions.canonical(long).count("C1:+") == 2999
    assert expressions.parse("λ x, " * 2000 + "x")[1] == "full" and expressions.parse("¬ " * 3000 + "p")[1] == "full"
    assert expressions.fnv1a(b"") == "cbf29ce484222325" and expressions.fnv1a(b"a") == "af63dc4c8601ec8c"


LEAN = """-- theorem no : x
/- theorem hidden /- nested -/ : y -/
@[simp] theorem add_zero (n : Nat) : n + 0 = n := by simp
def double (n : Nat) : Nat :=
  n + n -- add_zero
private lemma uses (h : p) [Foo α] : double 1 = 2 := by
  exact add_zero /- double -/
axiom choice : ∃ x, x = x
instance : Add Nat := ⟨plus⟩
instance named : Mul Nat := ⟨times⟩
example (a : A) : a = a := rfl
"""


def test_lean(spark):
    found = lean.declarations(LEAN)
    assert [(d["kind"], d["name"], d["line"]) for d in found] == [("theorem", "hidden", 2)] * 0 + [("theorem", "add_zero", 3), ("definition", "double", 4), ("theorem", "uses", 6), ("axiom", "choice", 8), ("instance", None, 9), ("instance", "named", 10), ("example", None, 11)]
    assert found[2]["context"] == ["h : p", "Foo α"] and found[2]["statement"] == "double 1 = 2" and found[1]["body"].startswith("n + n")
    files = spark.createDataFrame([("a.lean", LEAN), ("b.lean", None)], "path string, value string")
    deps = lean.dependencies(lean.parsed(files))
    assert {(r.from_order, r.to_order) for r in deps.collect()} == {(2, 0), (2, 1)}
    assert lean.references("x y' -- z\n x", {"x", "y'", "z"}) == ["x", "y'"]
    assert lean.proof_references("by exact foo (bar 1)")[0] == ["foo", "bar"]


TEX = r"""\newtheorem{satz}{\bf Théorème}\newenvironment{beweis}{\begin{proof}}{\end{proof}}\newcommand{\R}{\mathbb{R}}
\begin{document}
\begin{satz}\label{a} In $\R$ % \ref{no}
 all.\end{satz}
\begin{remark} between \end{remark}
\begin{beweis} by \ref{b}, \eqref{a} \cite{k1, k2}\end{beweis}
\begin{lemma}\label{b} low \end{lemma}
\begin{lemma}\label{c} other \end{lemma}
\begin{proof}[Proof of \ref{b}] see \cite[p. 3]{k1} \ref{zz}\end{proof}
\begin{thebibliography}{9}\bibitem{k1} {A}, arXiv:1234.56789. \newblock X \bibitem[lab]{k2} B, arXiv:math/0102003.\end{thebibliography}
\end{document}"""


def test_latex():
    rows = latex.theorems(TEX)
    assert [(r["kind"], r["label"], r["proof_match"], r["depends"], r["cites"]) for r in rows] == [("theorem", "a", "adjacent", ["b"], ["k1", "k2"]), ("remark", None, "none", [], []), ("lemma", "b", "titled", [], ["k1"]), ("lemma", "c", "none", [], [])]
    assert rows[0]["statement"] == r"\label{a} In $\mathbb{R}$ all." and rows[0]["line"] == 3
    assert latex.bibitems(TEX) == [("k1", "A , arXiv:1234.56789. X"), ("k2", "B, arXiv:math/0102003.")]
    assert latex.theorems("") == [] and latex.strip_comments(r"50\% % gone") == r"50\% "


PAGE = """<OAI-PMH><ListRecords>
<record><header><identifier>o:1</identifier></header><metadata><arXivRaw><id>2001.00001</id><version version="v1"><date>Mon, 1 Jan 2001</date></version><version version="v2"><date>Tue, 2 Feb 2010</date></version><title>A
 b</title><authors>X Y, Z and W</authors><categories>math.AG math.NT</categories><msc-class>11G05 (Primary), 14H52; 11R</msc-class><abstract> text </abstract></arXivRaw></metadata></record>
<record><header><identifier>o:2</identifier></header><metadata><arXivRaw><id></id><title>no id</title></arXivRaw></metadata></record>
</ListRecords></OAI-PMH>"""


def test_readers(spark, tmp_path):
    (tmp_path / "page.xml").write_text(PAGE)
    (paper,) = readers.papers(spark, str(tmp_path / "page.xml")).collect()
    assert (paper.arxiv_id, paper.title, paper.authors, paper.categories, paper.msc_codes, paper.year) == ("2001.00001", "A b", ["X Y", "Z", "W"], ["math.AG", "math.NT"], ["11G05", "14H52", "11R"], 2001)
    (tmp_path / "codes.tsv").write_text("code\ttext\tdescription\n11-XX\tNumber theory\t\n11Gxx\tCurves\tn\n11G05\tElliptic\t\n11-01\tBooks\t\n")
    assert [(r.code, r.level, r.parent, r.top) for r in readers.subject_codes(spark, str(tmp_path / "codes.tsv")).collect()] == [("11-XX", "top", None, "11-XX"), ("11Gxx", "section", "11-XX", "11-XX"), ("11G05", "leaf", "11Gxx", "11-XX"), ("11-01", "special", "11-XX", "11-XX")]
    (tmp_path / "bad.tsv").write_text("code\ttext\tdescription\nodd\tx\t\n")
    with pytest.raises(Exception, match="unknown shape"):
        readers.subject_codes(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"project": "p", "declarations": [{"name": "a", "module": "M", "publishedDependencies": [{"name": "b", "origin": "type"}]}, {"name": "c", "module": "M", "publishedDependencies": []}]}))
    assert [tuple(r) for r in readers.lean_manifest(spark, str(tmp_path / "m.json")).collect()] == [("p", "a", "M", "b", "type")]
    (tmp_path / "w.json").write_text('{"arxiv_id":"1","work_id":"W1","title":"t","referenced_work_ids":["W2","W0"]}\n')
    assert len(readers.works(spark, str(tmp_path / "w.json")).first().content_hash) == 64


def test_archives(spark, tmp_path):
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for name, text in (("b.tex", b"\\b"), ("a.tex", b"\\a"), ("c.png", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))
    for name, data in (("1", packed.getvalue()), ("2", gzip.compress(b"\\one")), ("3", b"%PDF-1"), ("4", b"plain")):
        (tmp_path / name).write_bytes(data)
    assert {r.path[-1]: r.source for r in readers.archives(spark, str(tmp_path)).collect()} == {"1": "\\a\n\\b", "2": "\\one", "3": None, "4": None}


def test_upserts_and_publishing(spark, tmp_path, monkeypatch):
    old = spark.createDataFrame([(1, 1, "a", 10), (2, 5, "b", 20)], "k long, v long, x string, born long")
    new = spark.createDataFrame([(1, 2, "c", 99), (2, 4, "late", 99), (3, 1, "n", 99)], "k long, v long, x string, born long")
    made = sinks.upsert(old, new, ["k"], "v", keep=("born",))
    want = {(1, 2, "c", 10), (2, 5, "b", 99), (3, 1, "n", 99)}
    assert {tuple(r) for r in made.select("k", "v", "x", "born").collect()} == want
    again = sinks.upsert(made, new, ["k"], "v", keep=("born",))
    assert {tuple(r)[:3] for r in again.select("k", "v", "x").collect()} == {w[:3] for w in want}
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        sinks.publish(spark.range(n), path)
        assert sinks.published(spark, path).count() == n
    monkeypatch.setattr(sinks, "point", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # a crash before the pointer moves
        sinks.publish(spark.range(9), path)
    assert sinks.published(spark, path).count() == 5 and sinks.published(spark, f"{path}x") is None
    assert sinks.manifest(spark, [f"{tmp_path}/t/CURRENT"]).count() == 1


def test_streams_are_idempotent(spark, tmp_path):
    source, table, appended = (str(tmp_path / x) for x in ("in", "table", "appended"))
    schema = "k long, v long"
    for batch in ([(1, 1), (2, 1)], [(1, 2), (3, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(schema).parquet(source)
        incremental.upsert_stream(stream(), f"file://{table}", f"{tmp_path}/c1", ["k"], "v").awaitTermination()
        incremental.append_new(stream(), f"file://{appended}", f"{tmp_path}/c2", ["k"]).awaitTermination()
    assert {tuple(r) for r in sinks.published(spark, f"file://{table}").select("k", "v").collect()} == {(1, 2), (2, 1), (3, 1)}
    assert sorted(r.k for r in spark.read.parquet(appended).collect()) == [1, 2, 3]


def test_harvest_stream_resumes(spark, tmp_path):
    spark.dataSource.register(incremental.HarvestSource)
    pages = tmp_path / "pages"
    pages.mkdir()
    for number in range(2):
        (pages / f"{number}.xml").write_text(f"<p>{number}</p>")

    def run():
        stream = spark.readStream.format("harvest").option("pages", str(pages)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.token for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [0, 1]
    (pages / "2.xml").write_text("<p>2</p>")
    assert run() == [0, 1, 2]
    assert [incremental.retry_delays(503, 7, 0), incremental.retry_delays(503, None, 0), incremental.retry_delays(None, None, 2), incremental.retry_delays(None, None, 5)] == [7, 15, 8, None]
