"""The folders that a sweep looks at and rewrites, against a walk up from each changed file, deepest first."""

import hashlib
import random

import pytest

from buildscope.operators import sweep


def mark(parts):
    return hashlib.sha256("|".join(f"{n}:{h}" for n, h in sorted(parts)).encode()).hexdigest()[:16]


def up(p):
    return p.rpartition("/")[0]


def brute(files, stored, changed):
    now, seen, todo = dict(stored), {}, {up(p) for p in changed}
    while todo:
        folder = max(todo, key=lambda p: (len(p.split("/")) if p else 0, p))
        todo.discard(folder)
        parts = [(p.rpartition("/")[2], h) for p, h in files.items() if up(p) == folder]
        parts += [(p.rpartition("/")[2], h) for p, h in now.items() if p and up(p) == folder]
        got = mark(parts) if parts else None
        again = got is not None and got != now.get(folder)
        seen[folder] = (got, again)
        if again:
            now[folder] = got
            if folder:
                todo.add(up(folder))
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_bubble_up(spark, seed):
    rng = random.Random(seed)
    folders = [""]
    for k in range(25):
        f = rng.choice(folders)
        folders.append(f"{f}/d{k}" if f else f"d{k}")
    files = {(f"{f}/x{k}.c" if f else f"x{k}.c"): f"h{rng.randint(0, 9)}" for k in range(50) for f in [rng.choice(folders)]}
    # up to date from the bottom, but for some
    stored = {}
    for f in sorted(folders, key=lambda p: -len(p.split("/")) if p else 0):
        parts = [(p.rpartition("/")[2], h) for p, h in files.items() if up(p) == f] + [(p.rpartition("/")[2], h) for p, h in stored.items() if p and up(p) == f]
        if parts and rng.random() < 0.9:
            stored[f] = mark(parts)
    saved = rng.sample(sorted(files), 6)
    for p in saved[:3]:
        files[p] = "new"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = sweep.bubble_up(frame(list(files.items()), "path string, hash string"), frame(list(stored.items()), "path string, fingerprint string"), frame([(p,) for p in saved] + [("nowhere/at/all.c",)], "path string")).collect()
    want = brute(files, stored, [*saved, "nowhere/at/all.c"])
    assert {r.path: (r.fingerprint, r.rewritten) for r in got} == want and len(got) == len(want)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    assert sweep.bubble_up(frame(list(files.items()), "path string, hash string"), frame(list(stored.items()), "path string, fingerprint string"), frame([], "path string")).count() == 0
