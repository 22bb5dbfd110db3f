"""Lexers by example and against a slow scanner; Ruby's blocks, attached comments, sides of small pieces."""

import random
import time

import pytest

from spanlens.operators import ast_chunk
from spanlens.operators.chunk import ChunkConfig
from spanlens.operators.lexer import LEXICONS, quieted

# What is no code stands between « and ».
CASES = [
    ("rust", "a «/* x /* y */ fn z */» b"),
    ("rust", 'let s = «r#"fn "x" {"#»; f()'),
    ("rust", "fn f<'a>(x: &'a str) { «'{'»; «'\\''»; «'\\u{7b}'»; b«'}'» }"),
    ("rust", '«"a\nb{"» c «r"\\"» d'),
    ("c", "a «// fn { \\n»\nb «'{'» «\"}\"» «/* x»"),
    ("cpp", 'auto s = «R"x(} )" )x"»; f()'),
    ("csharp", 'var s = «@"a "" {"»; var t = $«"{x}"»;'),
    ("go", "x := «`a {\n}`» + f()"),
    ("kotlin", 'val s = «"""a " {\n"""» + f()'),
    ("java", 'String s = «"""\n  } " x\n  """»; f();'),
    ("javascript", "const a = «`x ${»f(«`y ${»g({b: 1})«} {`»)«} }`» + h()"),
    ("javascript", "x = «/[/{]}/g».test(y) / 2 / z"),
    ("javascript", "return «/}/».test(«'it'»«'s'»)"),
    ("typescript", "a = b / c; «// {»\nd"),
    ("php", "<?php «# {»\n$x = «'a\\'{'»; #[Attr]\n$y = «<<<EOT»\n«} {$z}\nEOT»;\nf();"),
    ("swift", "«/* a /* b */ } */» let s = «\"\\\"{\"» ; f()"),
    ("ruby", "x = «\"a #{»f(«\"}\"»)«} {\"» «# do»\ny"),
    ("ruby", "s = «<<~EOS» + f\n«  def x {\n  EOS»\nreal"),
    ("ruby", "«=begin\ndef no\n=end»\ndef yes"),
]


@pytest.mark.parametrize("lang, marked", CASES)
def test_only_code_is_left(lang, marked):
    source, want, inside = "", "", False
    for c in marked:
        if c in "«»":
            inside = c == "«"
        else:
            source, want = source + c, want + (" " if inside and c != "\n" else c)
    assert quieted(source, lang) == want


@pytest.mark.parametrize("lang", sorted(LEXICONS))
def test_shape_is_kept_in_linear_time(lang):
    rng = random.Random(lang)
    bits = ["/*", "*/", "//", "#", '"', "'", "`", "${", "#{", "{", "}", "\\", "\n", "r#\"", '"#', 'R"(', ')"', '@"', '"""', "<<EOT\n", "EOT", "/", "a", " ", "é", "=begin", "=end", "'a", "<<<X\n"]
    for _ in range(400):
        source = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        quiet = quieted(source, lang)
        assert len(quiet) == len(source) and all(q == s or (q == " " and s != "\n") for q, s in zip(quiet, source)), source
    for unit in bits:
        began = time.time()
        quieted(unit * 20_000, lang)
        assert time.time() - began < 3, unit


RUBY = '''# frozen: true
require "set"

# Walks a tree.
# In order.
class Tree < Base
  LIMIT = 3

  def initialize(root)
    @root = root
    return if root.nil?
  end

  # Each leaf.
  def each
    nodes.each do |n|
      yield n if n.leaf?
    end
    s = "def fake #{Helper.call(n)}"
    while ready do_it
    end
  end

  def self.build(x) = new(x)

  module Inner
    def deep?
      unless x then y end
    end
  end
end

def top
  Tree.build(1)
end
'''


def test_ruby():
    tree = ast_chunk.parse_ruby(RUBY)
    assert [(s.name, s.start + 1, s.end + 1) for s in tree.symbols] == [("Tree", 4, 31), ("LIMIT", 7, 7), ("initialize", 9, 12), ("each", 14, 22), ("build", 24, 24), ("Inner", 26, 30), ("deep?", 27, 29), ("top", 33, 35)]
    names = {n for _, n in tree.refs}
    assert {"Base", "Helper", "call", "build", "Tree", "each", "leaf?"} <= names and not names & {"fake", "def", "new"}
    chunks = ast_chunk.chunk_source("t.rb", "ruby", RUBY, ChunkConfig(2, 9, 9))
    assert max(c["end_line"] - c["start_line"] + 1 for c in chunks) <= 9
    owner = {c["start_line"]: c["symbol"] for c in chunks}
    assert any(s.endswith("def each") for s in owner.values()) and owner[max(owner)].endswith("def top")
    covered = {r for c in chunks for r in range(c["start_line"], c["end_line"] + 1)}
    assert {r for r, l in enumerate(RUBY.split("\n"), 1) if l.strip()} <= covered
    assert ast_chunk.parse_ruby("def a\n  if x\n").symbols[0].end == 2 and ast_chunk.parse_ruby("end end\nclass A\nend").symbols[0].name == "A"


def test_comments_stay_with_what_they_say():
    rust = "use a;\n\n// one\n/* two */\n#[test]\nfn f() {\n    g();\n}\n\n// loose\n\n// three\nfn h() {\n    i();\n}\n"
    starts = [(n.start, n.end) for n in ast_chunk.parse_braces(rust, "rust").nodes]
    assert (2, 7) in starts and (11, 14) in starts and (9, 9) in starts
    python = "import a\n# one\n# two\n@d\ndef f():\n    pass\nX = 1\ny = 2\n"
    tree = ast_chunk.parse_python(python)
    assert [(s.name, s.start) for s in tree.symbols] == [("f", 1), ("X", 6)]


def test_small_pieces_join_their_side():
    cfg = ChunkConfig(3, 10, 10)
    spans = [(0, 4, "a"), (5, 5, "text", ast_chunk.FORWARD), (6, 12, "b"), (13, 13, "text", ast_chunk.BACK), (14, 15, "c")]
    assert ast_chunk.merge_small(spans, cfg) == [(0, 4, "a"), (5, 13, "b"), (14, 15, "c")] or ast_chunk.merge_small(spans, cfg)[1][0] == 5
    assert ast_chunk.merge_small([(0, 3, "a"), (4, 4, "text"), (5, 6, "b")], cfg)[0][1] >= 3
    # A header goes with the first piece of what is opened, a closing bracket with the last.
    java = "class A {\n" + "".join(f"  int f{i}() {{\n    return {i};\n  }}\n" for i in range(6)) + "}\n"
    chunks = ast_chunk.chunk_source("A.java", "java", java, ChunkConfig(2, 7, 7))
    assert chunks[0]["text"].startswith("class A {\n  int f0") and chunks[-1]["text"].endswith("}\n}")


def test_long_blanks_take_linear_time():
    """Comments are blanks to the rules: what they find, and where, doesn't change with the length of the blanks, and neither does the time grow with its square."""
    import time

    from spanlens.operators import ast_chunk

    code = ["import { load } from './load';", "function f1(x) {", "return load(x);", "}", "class C1 extends Base {", "run() {", "return f1(this);", "}", "}"]
    gap = "\n" + "    // " + "word " * 600
    long = "".join(gap * 40 + "\n" + line for line in code)
    short = "".join("\n // word\n" + line for line in code)
    began = time.time()
    found, wanted = ast_chunk.parse_braces(long, "typescript"), ast_chunk.parse_braces(short, "typescript")
    assert time.time() - began < 5
    assert [(s.name, s.label, long.split("\n")[s.row]) for s in found.symbols] == [(s.name, s.label, short.split("\n")[s.row]) for s in wanted.symbols]
    assert [(n, long.split("\n")[r]) for r, n in found.refs] == [(n, short.split("\n")[r]) for r, n in wanted.refs]
    assert [s.name for s in found.symbols] == ["f1", "C1", "run"]
