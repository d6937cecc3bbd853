"""ELF files on disk in all formats, in ranges of any size; mangled names within names."""

import pytest

from buildscope.functions.mangled import classified
from buildscope.plans.binary import image
from buildscope.sources import elf

SYMBOLS = [("", 0, 0, 0, 0), ("main", 0x1000, 8, 0x12, 1), ("dänger", 0x2000, 4, 0x21, 2), ("abs", 5, 0, 0x10, 0xFFF1), ("gone", 0, 0, 0x10, 0), ("odd", 1, 1, 0x7F, 1), ("main", 0x1010, 2, 0x02, 9)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("elf")
    for wide in (True, False):
        for little in (True, False):
            for dynamic in (True, False):
                (at / f"{wide:d}{little:d}{dynamic:d}.elf").write_bytes(image(SYMBOLS, wide, little, dynamic))
    whole = image(SYMBOLS, True, True)
    for name, data in {"cut": whole[: len(whole) - 100], "short": whole[:20], "text": b"x" * 100, "class": whole[:4] + b"\7" + whole[5:], "order": whole[:5] + b"\7" + whole[6:], "none": whole[:0x28] + bytes(8) + whole[0x30:]}.items():
        (at / name).write_bytes(data)
    return str(at)


@pytest.mark.parametrize("size", [1 << 16, 2, 1])
def test_files(spark, folder, size):
    files = elf.listed(spark, folder)
    got = elf.symbols(files, size=size).orderBy("file", "place").collect()
    names = {r.file.rsplit("/", 1)[-1] for r in got}
    assert names == {f"{w}{b}{d}.elf" for w in "01" for b in "01" for d in "01"}
    want = [(1, "main", 0x1000, 8, "func", "global", 1, ".text"), (2, "dänger", 0x2000, 4, "object", "weak", 2, ".data"), (3, "abs", 5, 0, "notype", "global", 0xFFF1, None), (4, "gone", 0, 0, "notype", "global", 0, None), (5, "odd", 1, 1, "other", "other", 1, ".text"), (6, "main", 0x1010, 2, "func", "local", 9, None)]
    for n in names:
        assert [tuple(r)[1:] for r in got if r.file.endswith(n)] == want


def test_sections(spark, folder):
    got = elf.sections(elf.listed(spark, folder)).collect()
    by = {r.file.rsplit("/", 1)[-1]: r for r in got}
    problems = {n: by[n].problem for n in ("cut", "short", "text", "class", "order", "none")}
    assert all(problems.values()) and problems["text"] == "no ELF file" and "class" in problems["class"] and "order" in problems["order"] and "headers" in problems["none"]
    assert [(r["index"], r.name, r.type) for r in sorted(got, key=lambda r: r["index"] or 0) if r.file.endswith("/101.elf")] == [(0, "", 0), (1, ".text", 1), (2, ".data", 1), (3, ".dynsym", 11), (4, ".strtab", 3), (5, ".shstrtab", 3)]
    assert {(r.file[-7:-4], r["class"], r.little_endian, r.stripped) for r in got if r.problem is None} == {(f"{w:d}{b:d}{d:d}", 64 if w else 32, b, d) for w in (True, False) for b in (True, False) for d in (True, False)}


def test_contents(spark):
    files = spark.createDataFrame([("a", bytearray(image(SYMBOLS, False, False)), 1), ("b", None, 2), ("c", bytearray(image([], True, True)), 3)], "file string, content binary, place int")
    assert elf.symbols(files).where("file = 'a'").count() == 6 and elf.symbols(files).count() == 6
    assert {r.file: r.problem for r in elf.sections(files).select("file", "problem").distinct().collect()} == {"a": None, "b": "no content", "c": None}


def test_blocks(monkeypatch):
    import io

    monkeypatch.setattr(elf, "BLOCK", 4)
    monkeypatch.setattr(elf, "KEPT", 2)
    data = b"abcdefgh\0ijklmnop"
    b = elf.Blocks(io.BytesIO(data), len(data))
    assert all(b.read(i, n) == data[i : i + n] for i in range(len(data)) for n in range(len(data) - i + 1))
    assert [b.text(i) for i in (0, 3, 8, 9, 16, 17, -1)] == ["abcdefgh", "defgh", "", "ijklmnop", "p", "", ""]
    with pytest.raises(elf.Unreadable):
        b.read(10, 8)


@pytest.mark.parametrize(
    ("name", "kind", "entity", "owner", "partial"),
    [
        ("_ZTVN2fw3hal4UartE", "vtable", "fw::hal::Uart", "fw::hal::Uart", False),
        ("_ZTV", "vtable", "_ZTV", None, True),
        ("_ZGVZZN1a1bEvE1cE1d", "guard-variable", "_ZZZN1a1bEvE1cE1d", None, True),
        ("_ZGVZN1aE", "guard-variable", "_ZZN1aE", None, True),
        ("_ZGVN1a1bE", "guard-variable", "a::b", "a", False),
        ("_ZGV_ZThn8_N1a1bEv", "guard-variable", "_Z_ZThn8_N1a1bEv", None, True),
        ("_ZThn8_N1aIN1bIiEEEC1Ev", "thunk", "a<...>", None, False),
        ("_ZTv0_n12_NK1a1fEv", "covariant-thunk", "a::f", "a", False),
        ("_ZN1aIN1bIN1cIN1dIiEEEEEE1fEv", "function", "a<...>", None, False),
        ("_ZN1aI1bI1cI1dI1eIiEEEEE1fEv", "function", "a<...>::f", "a<...>", False),
        ("_ZN5trun", "function", "_ZN5trun", None, True),
        ("_ZN1a1b", "function", "a::b", "a", True),
        ("_ZN0E", "function", "_ZN0E", None, True),
        ("_ZN", "function", "_ZN", None, True),
        ("_Z", "function", "_Z", None, True),
        ("_Z99999999999999x", "function", "_Z99999999999999x", None, True),
        ("_ZNrVK1a1bEv", "function", "a::b", "a", False),
        ("_ZZ4mainE1x", "local-static", "main::x", "main", False),
        ("_ZZ4mainEvE1x_0", "local-static", "main::x", "main", False),
        ("_ZZ", "local-static", "_ZZ", None, True),
        ("_Znwm", "runtime-support", "_Znwm", None, False),
        ("_Unwind_Resume", "runtime-support", "_Unwind_Resume", None, False),
        ("mallocx", "unmangled", "mallocx", None, False),
        ("__cxa_throw_x", "unmangled", "__cxa_throw_x", None, False),
        ("", "unmangled", "", None, False),
    ],
)
def test_names(name, kind, entity, owner, partial):
    got = classified(name)
    assert (got[0], got[1], got[2], got[4]) == (kind, entity, owner, partial)
