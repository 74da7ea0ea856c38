"""Verifiers by type. Code of records runs in its own limited process, never in the worker; apart from all else where the system allows it (see run_code)."""

from __future__ import annotations

import json
import os
import resource
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import isolation

SECONDS, MEMORY_MB, OUTPUT_BYTES = 5, 512, 1_000_000
#: Code runs apart or not at all.
REQUIRE_ISOLATION = False

_GUARD = """import sys, os as _o, socket as _s, subprocess as _p, _socket as _t
def _no(*a, **k): raise PermissionError("not allowed here")
for _m, _names in ((_s, ("socket", "create_connection", "socketpair")), (_t, ("socket", "SocketType", "socketpair")), (_p, ("Popen",)),
                   (_o, ("system", "popen", "fork", "forkpty", "posix_spawn", "posix_spawnp", "execv", "execve", "remove", "unlink", "rmdir", "rename", "kill", "killpg"))):
    for _n in _names:
        if hasattr(_m, _n): setattr(_m, _n, _no)
"""


def _limits() -> None:
    resource.setrlimit(resource.RLIMIT_AS, (MEMORY_MB << 20,) * 2)
    resource.setrlimit(resource.RLIMIT_CPU, (SECONDS,) * 2)
    resource.setrlimit(resource.RLIMIT_FSIZE, (OUTPUT_BYTES,) * 2)
    resource.setrlimit(resource.RLIMIT_NPROC, (64, 64)) if os.getuid() else None


def run_code(source: str, stdin: str = "", seconds: float = SECONDS) -> tuple[bool, str, str]:
    """(ended well, standard output, error) of a Python program in a process of its own, under time, memory, CPU and file limits.

    Where the system allows it (isolation.available()), the process has no network, no
    files but the interpreter's and its own folder, and can't begin others; that
    isn't left to the code's good will. Elsewhere only the guard stops sockets, processes
    and deletions, by their usual names, which is no sandbox: there, run executors
    in containers without a network. REQUIRE_ISOLATION makes that an error.
    """
    apart = isolation.available()
    if REQUIRE_ISOLATION and not apart:
        raise RuntimeError("this system doesn't let code run apart")
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "main.py")
        with open(path, "w", encoding="utf-8") as f:
            f.write(_GUARD + "\n" + source)

        def before() -> None:
            if apart:
                isolation.enter(folder)
            _limits()

        try:
            p = subprocess.run([os.path.realpath(sys.executable), "-I", "-S", path], input=stdin, capture_output=True, text=True, timeout=seconds, cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONIOENCODING": "utf-8"}, preexec_fn=before)
        except subprocess.TimeoutExpired:
            return False, "", "timeout"
        return p.returncode == 0, p.stdout[:OUTPUT_BYTES], p.stderr[-400:].strip().splitlines()[-1] if p.stderr.strip() else ""


def _verify(kind: str, details: str, answer: str) -> str | None:
    """Why a record fails; null if it passes."""
    try:
        d = json.loads(details or "{}")
    except ValueError:
        return "details: no JSON"
    if kind == "asserts":
        body = "\n".join(f"assert ({a.removeprefix('assert ')})" for a in d.get("python_asserts", []))
        ok, _, err = run_code("import math, re, json\nfrom fractions import Fraction\n" + f"response = answer = {answer!r}\n" + body)
        return None if ok else f"asserts: {err or 'failed'}"
    source = d.get("reference_solution", "")
    if name := d.get("function_name"):
        for k, t in enumerate([*d.get("function_tests", []), *d.get("hidden_function_tests", [])]):
            call = f"\n_t = {t!r}\n_got = {name}(*_t['args'])\nassert _got == _t['expected'] or json.dumps(_got) == json.dumps(_t['expected']), repr(_got)"
            ok, _, err = run_code("import json\n" + source + call)
            if not ok:
                return f"function test {k}: {err or 'failed'}"
    for k, t in enumerate([*d.get("public_tests", []), *d.get("hidden_tests", [])]):
        ok, out, err = run_code(source, t.get("input", ""))
        if not ok or out.strip() != str(t.get("output", "")).strip():
            return f"test {k}: {err or 'unlike output'}"
    if "program" in d:
        ok, out, err = run_code(d["program"])
        if not ok or out.strip() != str(d.get("expected_stdout", "")).strip():
            return f"program: {err or 'unlike output'}"
    for key in ("randomized_test_code", "randomized_function_test_code", "randomized_bruteforce"):
        if isinstance(d.get(key), str):
            ok, _, err = run_code(source + "\n" + d[key])
            if not ok:
                return f"{key}: {err or 'failed'}"
    return None


@F.pandas_udf(T.StringType())
def run_asserts(details: pd.Series, answer: pd.Series) -> pd.Series:
    """Reason of failure of details.python_asserts (JSON) about the answer, in a process of its own."""
    return pd.Series([_verify("asserts", d, a or "") for d, a in zip(details, answer, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def run_unit_tests(details: pd.Series) -> pd.Series:
    """Reason of failure of the tests in details (JSON): functions, standard input and output, traces, randomised code."""
    return pd.Series([_verify("tests", d, "") for d in details], dtype=object)


def exact_match(answer: Column, accepted: Column) -> Column:
    return F.when(~F.coalesce(F.array_contains(accepted, answer), F.lit(False)), "exact_match: not accepted")


def retrieval(urls: Column, facts: Column, family: Column) -> Column:
    few = F.when(family == "hotpotqa_agentic", 2).otherwise(1)
    return (
        F.when(F.coalesce(F.size(urls), F.lit(0)) < few, "retrieval_evidence: too few sources")
        .when(~F.forall(urls, lambda u: u.startswith("http")), "retrieval_evidence: a source is no link")
        .when(F.coalesce(F.size(facts), F.lit(0)) < 2, "retrieval_evidence: too few facts")
    )


def rubric(criteria: Column, n_messages: Column, mean_score: Column | None = None, least: float = 8.0) -> Column:
    out = F.when(F.coalesce(F.size(criteria), F.lit(0)) < 3, "llm_judge_rubric: too few criteria").when(n_messages < 4, "llm_judge_rubric: too few messages")
    return out.when(mean_score < least, "llm_judge_rubric: low score") if mean_score is not None else out


#: type: what verify() looks at; `human_review` always passes and other types fail.
TYPES = ("symbolic_math", "unit_tests", "json_schema", "regex", "exact_match", "retrieval_evidence", "llm_judge_rubric", "human_review")


def verify(df: DataFrame) -> DataFrame:
    """Adds reason (null: passed) to records (verifier_type, details JSON, final_answer, response, urls, family, n_messages).

    Only rows of a type go to its check: code runs for the rows that need it.
    """
    d = lambda path, kind: F.from_json(F.get_json_object("details", path), kind)
    t = F.col("verifier_type")
    asserts = run_asserts(F.col("details"), F.coalesce(F.when(t == "symbolic_math", F.col("final_answer")).otherwise(F.col("response")), F.lit("")))
    parts = [
        df.where(t.isin("symbolic_math", "json_schema", "regex")).withColumn("reason", asserts),
        df.where(t == "unit_tests").withColumn("reason", run_unit_tests(F.col("details"))),
        df.where(t == "exact_match").withColumn("reason", exact_match(F.col("final_answer"), d("$.accepted_answers", "array<string>"))),
        df.where(t == "retrieval_evidence").withColumn("reason", retrieval(F.col("urls"), d("$.required_supporting_facts", "array<string>"), F.col("family"))),
        df.where(t == "llm_judge_rubric").withColumn("reason", rubric(d("$.criteria", "array<string>"), F.col("n_messages"))),
        df.where(t == "human_review").withColumn("reason", F.lit(None).cast("string")),
        df.where(t.isNull() | ~t.isin(*TYPES)).withColumn("reason", F.concat(F.lit("unknown verifier: "), F.coalesce(t, F.lit("none")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(df: DataFrame, id_col: str, order: list[str], load_error: Column, verified: Column, cap_issues: Column, prosody: Column) -> DataFrame:
    """Adds reason: a load error, else a later copy of an id, else the verifier's, else the verse check's; caps only warn."""
    # Null ids are no copies of each other; the second key keeps them out of one task.
    rank = F.row_number().over(Window.partitionBy(id_col, F.when(F.col(id_col).isNull(), F.xxhash64(*order))).orderBy(*order))
    out = df.withColumn("_copy", F.when((rank > 1) & F.col(id_col).isNotNull(), "duplicate id"))
    return out.withColumn("reason", F.coalesce(load_error, F.col("_copy"), verified, prosody)).withColumn("warnings", cap_issues).drop("_copy")
