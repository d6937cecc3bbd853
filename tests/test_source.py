"""Outlines, calls and documented declarations on text by hand."""

from buildscope.operators import source as S

TEXT = """
#define OPEN {
namespace a::b { namespace {
template <class T> struct Box final : public Base<int>, detail::Other {
    explicit Box(int n) : size_(n), used_(0) { reset(); }
    ~Box() { }
    virtual T get() const noexcept override { if (ok()) { return get(); } return sizeof(T); }
    enum Kind { One, Two };
    int sizes[2] = { 1, 2 };
};
} }
int a::b::Box::count(void (*f)(int)) { while (f(1)) { do { step(); } while (x); } switch (y) { case 1: step(); } }
static int main(int c, char **v) { char q = '{'; /* } */ HAL_go(); other(); main(0); "call()"; }
void never(int) {
"""


def test_spans():
    got = [(s["kind"], s["name"], s["class"], s["namespace"], s["first_line"], s["last_line"]) for s in S.spans(TEXT)]
    assert got == [
        ("namespace", "a::b", None, None, 3, 11),
        ("namespace", "", None, "a::b", 3, 11),
        ("class", "Box", None, "a::b", 4, 10),
        ("function", "Box", "Box", "a::b", 5, 5),
        ("function", "~Box", "Box", "a::b", 6, 6),
        ("function", "get", "Box", "a::b", 7, 7),
        ("function", "count", "a::b::Box", None, 12, 12),
        ("function", "main", None, None, 13, 13),
    ]
    by = {s["name"]: s for s in S.spans(TEXT)}
    assert by["Box"]["kind"] == "function" and by["main"]["is_static"] and by["get"]["is_virtual"] and not by["count"]["is_virtual"]
    assert next(s for s in S.spans(TEXT) if s["kind"] == "class")["bases"] == ["Base<int>", "detail::Other"]
    for s in by.values():
        assert TEXT[s["body_start"]] == "{" and TEXT[s["body_end"] - 1] == "}" and TEXT[s["start"]].strip()
    assert S.spans("") == [] and S.spans("}}{{") == [] and S.spans("if (a) { b(); }") == []


def test_calls(spark):
    files = spark.createDataFrame([("t.cpp", TEXT, 1), ("u.c", "int f() { return g(h()); }\nint g(int x) { f(); f(); return x; }\nint f() { u(); g(1); }", 2), ("n.c", None, 3)], "file string, text string, callee int")
    got = {(r.file, r.caller, r.callee, r.is_extern) for r in S.calls(files, ["HAL_"]).collect()}
    assert got == {("t.cpp", "main", "HAL_go", True), ("u.c", "f", "g", False), ("u.c", "g", "f", False)}
    assert S.outlines(files.where("text is null")).count() == 0 and S.calls(files.limit(0), []).count() == 0


def test_documented(spark):
    text = {
        "a": ["/* one", " * two", " */", "", ".x :", "{", "}", ".x : again", "/* far */", "", "", "", "", "", ".y :", "/* near */", "", "", "", "", ".z :"],
        "b": ["/* first */ int q; /* last */", ".x :", "/* no */ stop", ".y :", ".w :"],
    }
    rows = [(f, n, x) for f, xs in text.items() for n, x in enumerate(xs)]
    got = {(r.file, r.name): r.comment for r in S.comments_of(spark.createDataFrame(rows, "file string, line_no int, line string"), r"^(\.\w+)").collect()}
    assert got == {("a", ".x"): "one\ntwo", ("a", ".y"): "", ("a", ".z"): "near", ("b", ".x"): "last", ("b", ".y"): "", ("b", ".w"): ""}
