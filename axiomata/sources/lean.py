"""Lean sources: declarations and the dependencies between them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import written
from . import expressions

KINDS = {"theorem": "theorem", "lemma": "theorem", "def": "definition", "axiom": "axiom", "instance": "instance", "example": "example"}
_START = re.compile(r"^\s*(?:@\[[^\]]*\]\s*)?(?:(?:private|protected|noncomputable|partial|unsafe|scoped|local)\s+)*(theorem|lemma|def|axiom|instance|example)\b\s*(.*)", re.S)
_WORD = re.compile(r"[\w']+")


def strip_comments(text: str) -> str:
    """P-05: without line comments and nested block comments."""
    out, depth = [], 0
    for part in re.split(r"(/-|-/|--[^\n]*)", text):
        if depth == 0 and part.startswith("--"):
            continue
        if part == "/-":
            depth += 1
        elif part == "-/" and depth:
            depth -= 1
        elif depth == 0:
            out.append(part)
    return "".join(out)


def _top_level(text: str, mark: str) -> int:
    """The place of a mark outside all brackets, or -1; ``:`` is not ``:=``."""
    depth = 0
    for k, c in enumerate(text):
        if c in "([{⟨":
            depth += 1
        elif c in ")]}⟩":
            depth -= 1
        elif depth == 0 and text.startswith(mark, k) and not (mark == ":" and text.startswith(":=", k)):
            return k
    return -1


def _starts(line: str) -> bool:
    """Whether a declaration starts with a line."""
    return not line.strip().startswith("--") and bool(_START.match(line))


def declarations(source: str) -> list[dict]:
    """P-04: a row for each declaration: kind, name, context, statement, body, raw text, line."""
    lines = source.split("\n")
    starts = [k for k, line in enumerate(lines) if _starts(line)]
    return [_declaration("\n".join(lines[start:end]), start + 1) for start, end in zip(starts, [*starts[1:], len(lines)], strict=True)]


def _declaration(raw: str, line: int) -> dict:
    """The declaration that a text starts with."""
    word, rest = (_START.match(strip_comments(raw)) or _START.match(raw)).groups()
    cut = _top_level(rest, ":=")
    signature, body = (rest, None) if cut < 0 else (rest[:cut], rest[cut + 2 :].strip())
    name = None
    if word != "example":
        found = re.match(r"\s*([^\s:({\[⟨]+)", signature)
        if found:
            name, signature = found[1], signature[found.end() :]
    colon = _top_level(signature, ":")
    context, statement = (signature, "") if colon < 0 else (signature[:colon], signature[colon + 1 :])
    groups = re.findall(r"[({\[]([^(){}\[\]]*(?:\([^()]*\)[^(){}\[\]]*)*)[)}\]]", context)
    return {"kind": KINDS[word], "name": name, "context": [" ".join(g.split()) for g in groups], "statement": " ".join(statement.split()), "body": body if word == "def" else None, "raw": raw, "line": line}


def references(text: str, known: set[str]) -> list[str]:
    """P-06: known names in order of first appearance."""
    return [w for w in dict.fromkeys(_WORD.findall(strip_comments(text))) if w in known]


def parsed(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """P-04, S-09: (path, order, kind, name, context, statement, hash, status, body, raw, line) of all declarations of each file.

    A file goes to Python line by line, in order, and a task holds the lines
    of one declaration, whatever the size of a file.
    """
    columns = ["path", "order", "kind", "name", "context", "statement", "hash", "status", "body", "raw", "line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, order, start, held = None, 0, 0, []

        def closed() -> list[dict]:
            if not held:
                return []
            d = _declaration("\n".join(held), start)
            node, status = expressions.parse(d["statement"])
            return [{"path": path, "order": order, **d, "hash": expressions.fnv1a(expressions.canonical(node).encode()), "status": status}]

        for pdf in batches:
            rows: list[dict] = []
            for p, at, line in zip(pdf["p"], pdf["at"], pdf["line"], strict=True):
                if at == 0:
                    rows += closed()
                    path, order, held = p, 0, []
                if _starts(line):
                    rows += closed()
                    order += bool(held)
                    start, held = at + 1, [line]
                elif held:
                    held.append(line)
            if rows:
                yield pd.DataFrame(rows)[columns]
        if held:
            yield pd.DataFrame(closed())[columns]

    lines = files.select(F.col(path).cast("string").alias("p"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    return lines.mapInPandas(run, "path string, order int, kind string, name string, context array<string>, statement string, hash string, status string, body string, raw string, line int")


def dependencies(declared: DataFrame) -> DataFrame:
    """P-07: (path, from_order, to_order): declarations of a file that a declaration's text names; of equal names the last counts."""
    declared = written(declared.select("path", "order", "name", "raw"), "declarations")
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?s)/-.*?-/", " "), r"--[^\n]*", " ")
    words = declared.select("path", F.col("order").alias("from_order"), F.col("name").alias("self"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)))).alias("name"))
    named = declared.filter("name is not null").groupBy("path", "name").agg(F.max("order").alias("to_order"))
    return words.join(named, ["path", "name"]).filter("self is null or self <> name").select("path", "from_order", "to_order")


def read(spark: SparkSession, path: str) -> DataFrame:
    """S-09: (path, value): every .lean file below a folder, each as one row."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.lean").select("_metadata.file_path", "value").toDF("path", "value")


def proof_references(text: str, keywords: frozenset[str] = frozenset("by exact apply intro intros rw simp have show from fun let in with at cases induction refine constructor rfl assumption calc obtain use ring linarith norm_num".split())) -> tuple[list[str], str]:
    """P-13: (names that a proof uses, hash of their sorted set)."""
    names = [w for w in dict.fromkeys(_WORD.findall(strip_comments(text))) if w not in keywords and not w[0].isdigit()]
    return names, expressions.fnv1a("\n".join(sorted(names)).encode())
