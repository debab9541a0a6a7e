r"""LaTeX sources: theorems, their proofs, what these refer to, and bibliographies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Theorem environments that need no declaration, and kinds that have no proof.
ENVIRONMENTS = {"theorem": "theorem", "lemma": "lemma", "proposition": "proposition", "corollary": "corollary", "definition": "definition", "remark": "remark", "conjecture": "conjecture"}
UNPROVED = ("definition", "remark", "example", "notation", "conjecture")
# Other names of kinds.
SYNONYMS = {"thm": "theorem", "théorème": "theorem", "theoreme": "theorem", "lem": "lemma", "lemme": "lemma", "prop": "proposition", "cor": "corollary", "corollaire": "corollary", "defn": "definition", "définition": "definition", "rem": "remark", "remarque": "remark"}


def strip_comments(tex: str) -> str:
    """P-08: without comments; an escaped percent sign stays."""
    return re.sub(r"(\\.)|%[^\n]*", lambda m: m[1] or "", tex, flags=re.S)


def kinds(tex: str) -> dict[str, str]:
    """P-08: environment names with their kinds, from the declarations and the fallback names."""
    out = dict(ENVIRONMENTS)
    for env, title in re.findall(r"\\newtheorem\*?\{([^}]*)\}(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", tex):
        clean = re.sub(r"\\[A-Za-z]+|[{}]", "", title).strip().lower()
        out[env] = SYNONYMS.get(clean, clean)
    return out


def proof_names(tex: str) -> set[str]:
    """P-08: environments whose opening code mentions proof."""
    return {"proof"} | {env for env, code in re.findall(r"\\newenvironment\{([^}]*)\}(?:\[[^\]]*\])*\{((?:[^{}]|\{[^{}]*\})*)\}", tex) if "proof" in code.lower()}


def macros(tex: str) -> dict[str, tuple[int, str]]:
    """P-12: macro names with their number of arguments (0 or 1) and bodies."""
    body = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
    out = {}
    for name, arity, code in re.findall(r"\\(?:re)?newcommand\*?\{?\\([A-Za-z]+)\}?(?:\[([0-9])\])?" + body, tex):
        if int(arity or 0) <= 1:
            out[name] = (int(arity or 0), code)
    for name, code in re.findall(r"\\def\\([A-Za-z]+)" + body, tex):
        out[name] = (0, code)
    for name, code in re.findall(r"\\DeclareMathOperator\*?\{\\([A-Za-z]+)\}" + body, tex):
        out[name] = (0, code)
    return out


def expand(text: str, known: dict[str, tuple[int, str]], passes: int = 8) -> str:
    """P-12: with macros replaced, again and again up to ``passes`` times."""

    def one(m: re.Match) -> str:
        if m[1] not in known:
            return m[0]
        arity, code = known[m[1]]
        if arity:
            return code.replace("#1", m[2]) if m[2] is not None else m[0]
        return code + (f"{{{m[2]}}}" if m[2] is not None else "")

    for _ in range(passes):
        new = re.sub(r"\\([A-Za-z]+)(?:\{([^{}]*)\})?", one, text)
        if new == text:
            break
        text = new
    return text


def environments(body: str, kind_of: dict[str, str], proofs: set[str]) -> list[dict]:
    """P-09: theorem and proof environments in order; what stands inside one is its text."""
    names = "|".join(re.escape(n) for n in sorted({*kind_of, *proofs}, key=len, reverse=True))
    out, at = [], 0
    start = re.compile(r"\\begin\{(" + names + r")(\*?)\}(?:\[((?:[^\[\]]|\[[^\]]*\])*)\])?")
    while m := start.search(body, at):
        end = body.find(f"\\end{{{m[1]}{m[2]}}}", m.end())
        if end < 0:
            at = m.end()
            continue
        out.append({"name": m[1], "proof": m[1] in proofs, "title": m[3], "text": body[m.end() : end], "start": m.start()})
        at = end
    return out


def theorems(tex: str) -> list[dict]:
    """P-10: a row for each theorem: kind, label, its proof's match, labels and keys that the proof refers to, statement, line.

    A proof whose title refers to a theorem is that theorem's; another goes
    back past kinds without proofs to the nearest theorem that has none yet.
    """
    tex = strip_comments(tex)
    kind_of, known = kinds(tex), macros(tex)
    begin = re.search(r"\\begin\{document\}", tex)
    offset = begin.end() if begin else 0
    found = environments(tex[offset:], kind_of, proof_names(tex))
    for e in found:
        label = re.search(r"\\label\{([^}]*)\}", e["text"])
        e["label"] = label[1] if label and not e["proof"] else None
        e["kind"] = None if e["proof"] else kind_of[e["name"]]
        e["by"] = None
    of_label = {e["label"]: e for e in found if e["label"]}
    for e in found:
        e["titled"] = False
        if e["proof"]:
            for label in re.findall(r"\\ref\{([^}]*)\}", e["title"] or ""):
                if label in of_label:
                    e["titled"] = True
                    if of_label[label]["by"] is None:
                        of_label[label]["by"] = (e["text"], "titled")
    for k, e in enumerate(found):
        if not e["proof"] or e["titled"]:
            continue
        for before in reversed(found[:k]):
            if before["proof"] or before["by"]:
                break
            if before["kind"] not in UNPROVED:
                before["by"] = (e["text"], "adjacent")
                break
    out = []
    for e in found:
        if e["proof"]:
            continue
        proof, match = e["by"] or ("", "none")
        refs = re.findall(r"\\ref\{([^}]*)\}", proof) + re.findall(r"\\eqref\{([^}]*)\}", proof)
        cites = [c.strip() for group in re.findall(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}", proof) for c in group.split(",")]
        out.append({"order": len(out), "kind": e["kind"], "label": e["label"], "has_proof": match != "none", "proof_match": match, "depends": [r for r in dict.fromkeys(refs) if r in of_label and r != e["label"]], "cites": [c for c in dict.fromkeys(cites) if c], "statement": " ".join(expand(e["text"], known).split()), "line": tex.count("\n", 0, offset + e["start"]) + 1})
    return out


def bibitems(tex: str) -> list[tuple[str, str]]:
    """P-11: (key, text) of a bibliography."""
    body = strip_comments(tex).split("\\end{thebibliography}")[0]
    parts = re.split(r"\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}", body)
    return [(key, " ".join(re.sub(r"\\newblock|[{}]", " ", text).split())) for key, text in zip(parts[1::2], parts[2::2], strict=True)]


THEOREM = "paper string, order int, kind string, label string, has_proof boolean, proof_match string, depends array<string>, cites array<string>, statement string, line int"


def parsed(sources: DataFrame, paper: str, text: str) -> DataFrame:
    """P-10 over a table of sources, an Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"paper": p, **t} for p, tex in zip(pdf["p"], pdf["t"], strict=True) for t in theorems(tex or "")]
            if rows:
                yield pd.DataFrame(rows)[[c.split()[0] for c in THEOREM.split(", ")]]

    return sources.select(F.col(paper).cast("string").alias("p"), F.col(text).alias("t")).mapInPandas(run, THEOREM)


def bibliography(sources: DataFrame, paper: str, text: str) -> DataFrame:
    """P-11, T-33: (paper, key, entry, cited) with the preprint that each entry names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, e) for p, tex in zip(pdf["p"], pdf["t"], strict=True) for k, e in bibitems(tex or "")]
            if rows:
                yield pd.DataFrame(rows, columns=["paper", "key", "entry"])

    made = sources.select(F.col(paper).cast("string").alias("p"), F.col(text).alias("t")).mapInPandas(run, "paper string, key string, entry string")
    return made.withColumn("cited", T.cited_id(F.col("entry")))


def dependencies(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-06: (paper, from_order, to_order) of references that hit a label, and those that don't (paper, from_order, label)."""
    wanted = found.select("paper", F.col("order").alias("from_order"), F.explode("depends").alias("label"))
    labels = found.filter("label is not null").groupBy("paper", "label").agg(F.max("order").alias("to_order"))
    return wanted.join(labels, ["paper", "label"]).select("paper", "from_order", "to_order"), wanted.join(labels, ["paper", "label"], "left_anti")


def citations(found: DataFrame, entries: DataFrame, papers: DataFrame) -> DataFrame:
    """J-07: (src, dst): papers that a paper's proofs cite, known ones, itself left out."""
    keys = found.select("paper", F.explode("cites").alias("key")).distinct()
    hit = keys.join(entries.filter("cited is not null").select("paper", "key", "cited"), ["paper", "key"])
    return hit.join(papers.select(F.col("paper").alias("cited")).distinct(), "cited").filter("paper <> cited").select(F.col("paper").alias("src"), F.col("cited").alias("dst")).distinct()
