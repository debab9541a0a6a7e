import random

from axiomata import __main__ as command
from axiomata import flow


def corpus():
    random.seed(9)
    fields = {"algebra": ["finite group", "abelian group", "group action", "normal subgroup"], "geometry": ["smooth manifold", "manifolds", "tangent bundle", "vector field"]}
    rows = []
    for k in range(90):
        label = random.choice(list(fields))
        own = random.sample(fields[label], 3)
        text = f"The {own[0]} and the {own[1]}. We use the {own[2]}. This is the main theorem." + " Take a finite group, such as the abelian group." * (label == "algebra")
        rows.append((k, text, label))
    return rows


def test_from_documents_to_exports(spark, tmp_path, capsys):
    rows = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    rows.write.parquet(f"{tmp_path}/docs")
    out = f"file://{tmp_path}/out"
    assert command.main(["build", f"{tmp_path}/docs", out, "--dim", "4"]) == 0
    counts = dict(line.split("\t") for line in capsys.readouterr().out.splitlines() if "\t" in line)
    assert set(counts) == set(flow.TABLES) and all(int(counts[t]) > 0 for t in ("concepts", "links", "vectors", "edges", "clusters", "relations", "taxonomy"))
    from axiomata.operators import sinks

    names = {r.phrase for r in sinks.published(spark, f"{out}/concepts").collect()}
    assert {"finite group", "abelian group", "tangent bundle"} <= names and "main theorem" not in names
    kinds = {(r.subject, r.object, r.kind) for r in sinks.published(spark, f"{out}/relations").collect()}
    assert ("abelian group", "finite group", "specialization_of") in kinds
    hits = {(r.tier, r.phrase) for r in flow.find(spark, out, ["finite groups"]).collect()}
    assert ("exact", "finite group") in hits
    assert command.main(["show", out, "concepts", "--where", "phrase=finite group"]) == 0
    assert "finite group" in capsys.readouterr().out
    assert command.main(["search", out, "tangent bundle"]) == 0
    assert command.main(["check", out]) == 0
