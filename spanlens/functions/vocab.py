"""Word lists, names and patterns that results depend on. Plain text, kept together."""

from __future__ import annotations

# Words that carry no retrieval signal in a prompt.
PROMPT_STOPLIST = tuple(
    """
    a about above after again all also am an and any are as at be because been before being below between both but by
    can could did do does doing done down during each either else etc ever every few for from further had has have
    having he her here his how however i if in into is it its itself just let lets me might more most much must my no
    nor not now of off on once one only or other our out over own please same shall she should so some such than that
    the their them then there these they this those through thus to too under until up upon us very via was we were
    what when where whether which while who whom whose why will with within without would yes yet you your yours
    answer briefly codebase comma describe efficient efficiently exactly explain find following give help identify
    implements look need needs project relevant repository separated show tell understand want
    """.split()
)

# Words that point back to an earlier prompt.
BACK_REFERENCES = ("same", "above", "previous", "earlier", "aforementioned")

# Words that ask for tests, and for callers.
TEST_WORDS = ("test", "tests", "tested", "testing", "coverage")
CALLER_WORDS = ("caller", "callers", "callsite", "callsites", "invoke", "invokes", "invoked", "usage", "usages")

# Words that ask for prose or configuration.
NON_CODE_INTENT = tuple("readme doc docs documentation guide markdown changelog config configuration toml yaml yml json dockerfile makefile ci workflow".split())

# Phrases that mark a sentence as an instruction about the answer.
OUTPUT_FORMAT_MARKERS = (
    "your answer",
    "your response",
    "of the form",
    "answer with",
    "respond with",
    "reply with",
    "output format",
    "be efficient",
    "be concise",
    "be brief",
    "read only what",
)

# Extensions that make a token a path mention.
PATH_EXTENSIONS = tuple("rs py ts tsx js jsx mjs cjs go java c h cc cpp cxx hpp cs rb php kt kts swift md toml json yaml yml".split())

# Directories, files and extensions by language.
SKIP_DIRS = tuple("target node_modules dist build .git vendor __pycache__ .venv venv .next .gradle .mypy_cache .pytest_cache .tox".split())
SKIP_FILES = tuple(
    """cargo.lock package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb poetry.lock pipfile.lock
    gemfile.lock composer.lock go.sum flake.lock uv.lock package.resolved""".split()
)
BARE_NAMES = {
    "ruby": tuple("rakefile gemfile guardfile podfile vagrantfile".split()),
    "text": tuple("makefile gnumakefile dockerfile containerfile justfile procfile readme license copying changelog authors codeowners cmakelists.txt".split()),
}
EXTENSIONS = {
    "rust": ("rs",),
    "python": ("py", "pyi", "pyw"),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": tuple("cc cpp cxx c++ hh hpp hxx h++ ipp tpp cu cuh".split()),
    "csharp": ("cs",),
    "ruby": ("rb", "rake", "gemspec", "ru"),
    "php": ("php", "phtml"),
    "kotlin": ("kt", "kts"),
    "swift": ("swift",),
    "text": tuple(
        """md markdown mdx txt rst adoc org tex toml yaml yml json jsonc json5 ini cfg conf properties xml html htm css
        scss sass less sh bash zsh fish ps1 bat cmd sql proto graphql gql thrift cmake mk make gradle dockerfile tf hcl
        nix lua scala sc zig ex exs erl hrl hs ml mli r jl dart vue svelte astro pl pm vim el clj cljs edn fs fsx csv
        tsv mod work cabal sbt tmpl tpl j2 jinja hbs mustache rego cue bzl bazel star wgsl glsl hlsl metal v sv vhd asm
        s nim cr d m mm groovy pyx pxd ipynb""".split()
    ),
}

# Documentation files.
PROSE_EXTENSIONS = ("md", "markdown", "mdx", "rst", "adoc", "org")
PROSE_NAMES = tuple("readme changelog changes history license copying authors contributing notice".split())

# Test directories, and endings of a test file's stem.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
TEST_STEM_ENDS = ("_test", "_tests", "_spec", ".test", ".spec", "Tests", "Test")
