"""Paths, languages, frameworks, roles, limits."""

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import text
from srcgraph.operators import files as fl


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_language_by_extension(rows):
    paths = ["/a.b/x.TSX", "/a/.ts", "/a.ts/README", "x.mjs", "x.py", "x.GO", "x.cjs", "x.prisma", "a.tar.js"]
    df = rows([(p,) for p in paths], "path string").select(text.detect_language(F.col("path")).alias("l"))
    assert values(df, "l") == ["typescript", "unknown", "unknown", "javascript", "python", "go", "javascript",
                               "unknown", "javascript"]


def test_scan_keeps_underscore_names(files):
    df = files(*[(p, "") for p in (
        "a/__init__.py", "a/.env.example", "a/m.ts", "a/node_modules/z/i.js", "a/.git/x.ts", "a/_p.py",
        "a/__pycache__/x.pyc", "node_modules/q.js", "a/node_modules2/k.js")])
    assert values(fl.scan_files(df).orderBy("ord"), "path") == ["a/__init__.py", "a/m.ts", "a/_p.py", "a/node_modules2/k.js"]


def test_read_text_replaces_bad_bytes_and_skips_empty(rows):
    df = rows([(1, 0, "a", bytearray(b"ok \xff!")), (1, 1, "b", None), (1, 2, "c", bytearray(b""))],
              "repo_id bigint, ord bigint, path string, content binary")
    assert values(fl.read_text(df), "content") == ["ok �!"]


def test_short_path(rows):
    df = rows([("a/b",), ("q/w/e/r",), ("q\\w\\e\\r",), ("x",)], "p string").select(text.short_path(F.col("p")).alias("s"))
    assert values(df, "s") == ["a/b", "w/e/r", "w/e/r", "x"]


def test_relative_path(rows):
    df = rows([("/r/a/b.ts",), ("/other/x",)], "path string")
    got = fl.relative_path(df, F.lit("/r"))
    assert values(got, "rel_path") == ["/a/b.ts", "/other/x"]


def test_repo_url(rows):
    urls = {
        "https://GitHub.com/a/b": True, "ssh://github.com/a/b": True, "https://github.com/a/b?x#y": True,
        "https://www.github.com/a/b": False, "git@github.com:a/b": False, "https://github.com/a/b/": False,
        "https://github.com/a/b.git": True, "https://user:pw@github.com:443/a/b": True, "https://github.com/a": False,
        "not a url": False, "": False, "ssh://GitHub.com/a/b": False, "https://github.com/a/..": False,
        " https://github.com/a/b ": True,
    }
    df = rows([(u,) for u in urls], "u string").select("u", text.is_repo_url(F.col("u")).alias("ok"))
    assert {r["u"]: r["ok"] for r in df.collect()} == urls
    assert rows([(None,)], "u string").select(text.is_repo_url(F.col("u")).alias("ok")).first()["ok"] is False


def test_label_key_trims_every_js_blank(rows):
    df = rows([("\t Ab ﻿",), (" AB\n",), ("a b",)], "l string").select(text.label_key(F.col("l")).alias("k"))
    assert values(df, "k") == ["ab", "ab", "a b"]


def test_primary_language_is_the_first_known_file(files):
    df = files(("r.md", ""), ("a.py", ""), ("b.ts", ""), ("c.py", ""))
    got = fl.repo_languages(df).orderBy("rank")
    assert values(got, "rank", "language") == [(0, "python"), (1, "typescript")]
    first = fl.primary_language(df).first()
    assert (first["primary_language"], first["family"]) == ("python", "python")
    assert fl.primary_language(files(("r.md", ""))).count() == 0


@pytest.mark.parametrize("pairs, expected", [
    ([("a.py", "from fastapi import X"), ("b.ts", "express()")], "fastapi"),
    ([("x/prisma/schema.prisma", ""), ("a.py", "from fastapi import X")], "express+prisma"),
    ([("next.config.js", ""), ("b.ts", "express()")], "nextjs"),
    ([("a.go", "r := gin.New()")], "gin"),
    ([("a.ts", "NestFactory.create(App)")], "nestjs"),
    ([("readme.md", "express()")], "unknown"),
])
def test_framework(files, pairs, expected):
    assert fl.detect_framework(files(*pairs)).first()["framework"] == expected


def test_framework_reads_all_files(files):
    many = [(f"f{i}.ts", "x") for i in range(20)]
    late = files(*many, ("z.ts", "express()"))
    assert fl.detect_framework(late).first()["framework"] == "express"
    assert fl.detect_framework(files(*many, ("next.config.mjs", ""))).first()["framework"] == "nextjs"


def test_candidates_keep_the_earliest_place(files):
    df = files(("src/App.tsx", ""), ("src/HomePage.tsx", ""), ("src/lib.ts", ""))
    planned = df.filter("path = 'src/lib.ts' or path = 'src/App.tsx'")
    got = fl.feature_candidates(df, planned).orderBy("pass", "ord")
    assert values(got, "path", "pass") == [("src/HomePage.tsx", 0), ("src/App.tsx", 1), ("src/lib.ts", 2)]


def test_steps_look_at_all_their_files(files):
    df = files(*[(f"m{i}_model.ts", "") for i in range(30)], ("package.json", ""), ("x.md", ""))
    got = {r["agent"]: r["n"] for r in fl.step_targets(df).groupBy("agent").agg(F.count("*").alias("n")).collect()}
    assert got == {"plan": 30, "api": 30, "data": 30, "service": 30, "infra_source": 30, "infra_config": 1}
