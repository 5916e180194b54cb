"""Folders listed by tasks, against a plain walk; globs against fnmatch."""

import os
import random
from fnmatch import fnmatchcase

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lodestone.sources import code_files
from lodestone.sources.globs import Globs

PIECES = st.lists(st.sampled_from(["*", "?", "a", "b", ".", "/", "[ab]", "[!a]", "[a-c]", "[", "é", "**"]), max_size=6).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4), st.text("abc./é[", max_size=10))
@example(["*.log", "build", "a[!b]c"], "build")
@example(["[]a]"], "]")
@example([""], "")
@example(["*"], "")
def test_globs_are_those_of_fnmatch(patterns, text):
    globs = Globs(patterns)
    assert globs.match(text) == any(fnmatchcase(text, p) for p in patterns)
    for cut in range(len(text) + 1):  # the state can be kept between two parts
        assert globs.accepts(globs.step(globs.step(globs.start, text[:cut]), text[cut:])) == globs.match(text)


def test_many_globs_take_one_pass():
    globs = Globs([f"*{i}.tmp" for i in range(2000)])
    assert globs.match("a/b/c1999.tmp") and not globs.match("a/b/c1999.tmpx") and not Globs([]).match("a")


def plain_walk(root):
    patterns = code_files.root_patterns(root)
    ignored = lambda name, rel: any(fnmatchcase(x, p) for p in patterns for x in (name, rel))
    for folder, folders, names in os.walk(root):
        rel = lambda n, f=folder: os.path.relpath(os.path.join(f, n), root)
        folders[:] = [d for d in folders if d[0] != "." and d not in code_files.SKIPPED_FOLDERS and not ignored(d, rel(d))]
        yield from (rel(n) for n in names if n[0] != "." and not ignored(n, rel(n)) and os.path.splitext(n)[1].lower() not in code_files.BINARY_EXTENSIONS)


@pytest.fixture
def forest(tmp_path):
    pick = random.Random(5)
    folders = [""]
    for _ in range(60):
        name = pick.choice(["src", "build", "venv", ".git", "_lib", "é x", "out1", "node_modules"]) + str(pick.randrange(3)) * pick.randrange(2)
        folders.append(os.path.join(pick.choice(folders), name))
    for folder in folders:
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for n in range(5):
            (tmp_path / folder / (pick.choice(["a", "_b", ".c", "debug", "keep"]) + str(n) + pick.choice([".py", ".log", ".PNG", "", ".txt"]))).write_text(f"{folder} {n}\n")
    (tmp_path / ".gitignore").write_text("# none\n*.log\nbuild/\nsrc/*/keep?.txt\nout[0-9]\n\n")
    (tmp_path / "src").mkdir(exist_ok=True)
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    return str(tmp_path)


@pytest.mark.parametrize("per_task", [1, 7, 20_000])
def test_tasks_list_what_a_walk_lists(spark, forest, per_task):
    found = sorted(r.rel_path for r in code_files.list_files(spark, forest, per_task).collect())
    assert found == sorted(plain_walk(forest)) and len(found) > 20


def test_discovery_reads_them(spark, forest):
    rows = code_files.discover(spark, "file://" + forest + "/").collect()
    assert sorted(r.rel_path for r in rows) == sorted(plain_walk(forest))
    assert all(r.content == open(r.file_path).read() for r in rows)


def test_nothing_to_find(spark, tmp_path):
    assert code_files.discover(spark, str(tmp_path)).count() == 0
    assert code_files.discover(spark, str(tmp_path / "none")).count() == 0
