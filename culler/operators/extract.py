"""Method extraction from source files (S1, S2, E1-E16, P1-P4, W4) on the file row.

A file is one row and stays one row until its methods are exploded: no shuffle, no join, no line table.
1. Literals and comments are read from left to right, each in its own state (strings, characters, templates, text
   blocks, heredocs, regular expressions, comments), and what could open, close or end something in them is put
   out of sight, one character for one.
2. Header patterns run over the whole text and put a mark before and after every header, so a header may
   span lines, carry its attributes inline or above, and have its ``{`` on a line of its own.
3. The text falls apart into tokens at the marks and at what can close a method (braces, lines, ``end``),
   and one fold over the tokens tracks the nesting and emits the methods' ranges.
   Only outermost methods count, as the ranges of a left-to-right search never overlap: a ``describe`` holds
   its ``it`` calls, a function the functions inside.  Each has its whole body at any depth.
   * brace languages: from the header to the brace that closes the one it opened (V5); a body that never closes
     gives no method and costs none of the methods after its header;
   * Python: to the last logical line with code before one that is indented no deeper than the ``def``; lines inside brackets
     and text blocks, after a backslash and with nothing but a comment end nothing;
   * Ruby: to the first word ``end`` after ``def``.
4. Fields come from the header's own text; doc comments from the lines or characters above.

A method's key is (suite, path, method_seq);
``method_seq`` is its ordinal in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culler.functions import lang_rules as LR
from culler.functions.text import clean_code, strip_ws

# Marks before and after a header; such characters in a source file become blanks first.
HEAD, REST = "\x01", "\x02"
# Marks around a literal, and the characters that stand for others inside literals (Unicode has none there).
LITERAL, AFTER = "\x03", "\x04"
HIDDEN = "\n()[]{};"
HIDES = "".join(chr(0xFDD0 + i) for i in range(len(HIDDEN)))
_RANGE = "array<struct<s:int,e:int,ls:int,le:int,head:string>>"


# ---------------- S2 / E1 ----------------

def detect_language(files: DataFrame, path: str = "path", rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    """Lower-cased extension -> language; unknown extension -> NULL language
    (callers route those to a rejects frame instead of failing the job)."""
    ext = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    m = F.create_map(*[x for e, l in LR.extension_map(rules).items() for x in (F.lit(e), F.lit(l))])
    return files.withColumn("ext", ext).withColumn("language", m[F.col("ext")])


def explode_lines(files: DataFrame) -> DataFrame:
    """(suite, path, language, line_no 1-based, line)."""
    return files.select("suite", "path", "language",
                        F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select(
        "suite", "path", "language", (F.col("pos") + 1).alias("line_no"), "line")


# ---------------- headers ----------------

def _lang_case(values: dict[str, Column], default: Column) -> Column:
    expr = None
    for lang, v in values.items():
        expr = F.when(F.col("language") == lang, v) if expr is None else expr.when(F.col("language") == lang, v)
    return expr.otherwise(default) if expr is not None else default


def _any_header(r: LR.LangRules) -> str:
    return "|".join(f"(?:{rx})" for rx, _ in r.headers)


def _text() -> Column:
    return F.translate("content", HEAD + REST + LITERAL + AFTER, "    ")


def _hidden(text: Column, r: LR.LangRules) -> Column:
    """The text with HIDES for HIDDEN inside literals and comments; in brace languages line ends stay."""
    if not r.literals:
        return text
    pieces = F.split(F.regexp_replace(text, F.lit(f"({r.literals})"), F.lit(f"{LITERAL}$1{AFTER}")), LITERAL, -1)
    k = 0 if r.block == "indent" else 1
    hide = lambda lit: F.translate(lit, HIDDEN[k:], HIDES[k:])
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(
        F.concat(hide(F.substring_index(p, AFTER, 1)), F.substr(p, F.instr(p, AFTER) + 1)))), "")


def _shown(text: Column) -> Column:
    return F.translate(text, HIDES, HIDDEN)


def _marked(rules: dict[str, LR.LangRules]) -> Column:
    """The text, literals hidden, with every header between HEAD and REST."""
    return _lang_case({k: F.regexp_replace(_hidden(_text(), r), F.lit(f"({_any_header(r)})"), F.lit(f"{HEAD}$1{REST}")) for k, r in rules.items()}, _text())


def _field(rules: dict[str, LR.LangRules], name: str, head: Column, show: bool = True) -> Column:
    """A field of a header: the group of the first pattern that matches it; without ``show`` its literals stay hidden."""
    out = {}
    for k, r in rules.items():
        expr = None
        for rx, groups in r.headers:
            hit = head.rlike(rf"\A(?:{rx})\z")
            value = F.regexp_extract(head, rf"\A(?:{rx})\z", groups[name]) if name in groups else F.lit("")
            if len(r.headers) == 1:
                expr = value
            else:
                expr = F.when(hit, value) if expr is None else expr.when(hit, value)
        out[k] = expr
    value = F.coalesce(_lang_case(out, F.lit("")), F.lit(""))
    return _shown(value) if show else value


def _newlines(t: Column) -> Column:
    return F.char_length(t) - F.char_length(F.translate(t, HIDDEN[0] + HIDES[0], ""))


def method_headers(files: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    """Every header of every file, nested ones too: (suite, path, line_no of the header proper, name)."""
    rules = rules or LR.RULES
    pieces = F.split(_marked(rules), HEAD, -1)
    # lines before each piece: a running sum inside the row
    counts = F.transform(pieces, _newlines)
    before = F.aggregate(counts, F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = _known(files, rules).select("suite", "path", "language", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.slice(before, 1, F.size(pieces)).alias("line"))).alias("i", "p"))
    rows = rows.filter("i > 0").withColumn("head", F.substring_index("p.piece", REST, 1))
    return rows.select("suite", "path", (F.col("p.line") + _newlines(_field(rules, "attrs", F.col("head")))).alias("line_no"),
                       _field(rules, "name", F.col("head")).alias("name"))


def _known(files: DataFrame, rules: dict[str, LR.LangRules]) -> DataFrame:
    if "language" not in files.columns:
        files = detect_language(files, rules=rules)
    return files.filter(F.col("language").isNotNull() & (F.length(F.trim("content")) > 0))


# ---------------- ranges ----------------

def _tokens(cut: str, facts) -> Column:
    """Header tokens and what lies between, cut after every match of ``cut``, as structs: head (is a header), rest
    (the first token after one), text, n (characters), nl (line ends) and ``facts`` of the text."""
    pieces = F.split("_marked", HEAD, -1)
    token = lambda t, head, rest: F.struct(t.alias("text"), head.alias("head"), rest.alias("rest"), F.char_length(t).alias("n"),
                                           _newlines(t).alias("nl"), *[c.alias(k) for k, c in facts(t).items()])
    no, yes = F.lit(False), F.lit(True)
    before = lambda p: F.transform(F.split(p, cut, -1), lambda t: token(t, no, no))
    after = lambda p: F.transform(F.split(F.substr(p, F.instr(p, REST) + 1), cut, -1), lambda t, j: token(t, no, j == 0))
    return F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, before(p)).otherwise(
        F.concat(F.array(token(F.substring_index(p, REST, 1), yes, no)), after(p)))))


_START = {"off": 0, "line": 1, "depth": 0, "open": -1, "s": 0, "ls": 0, "e": 0, "le": 0}


def _state(s: Column, t: Column, starts: Column, ends: Column, out: Column, **v: Column) -> Column:
    """The next state: positions advance, a method that starts sets s, ls and head, one that ends goes to out."""
    v = {"off": s["off"] + t["n"], "line": s["line"] + t["nl"], "s": F.when(starts, s["off"]).otherwise(s["s"]),
         "ls": F.when(starts, s["line"]).otherwise(s["ls"])} | v
    return F.struct(*[v.get(k, s[k]).alias(k) for k in _START], F.when(starts, t["text"]).otherwise(s["head"]).alias("head"),
                    F.when(ends, out).otherwise(s["out"]).alias("out"))


def _emit(s: Column, e: Column, le: Column) -> Column:
    return F.concat(s["out"], F.array(F.struct(s["s"].alias("s"), e.alias("e"), s["ls"].alias("ls"), le.alias("le"), s["head"].alias("head"))))


def _line_ranges(cut: str, step, facts) -> Column:
    zero = F.struct(*[F.lit(x).alias(k) for k, x in _START.items()], F.lit("").alias("head"), F.array().cast(_RANGE).alias("out"))
    return F.aggregate(_tokens(cut, facts), zero, step, lambda s: F.when(s["open"] <= -2, _emit(s, s["e"], s["le"])).otherwise(s["out"]))


def _brace_facts(t: Column) -> dict[str, Column]:
    return {"by": F.when(t.endswith("{"), 1).when(t.endswith("}"), -1).otherwise(0)}


_OPEN = "array<struct<depth:int,s:int,ls:int,n:int,head:string>>"


def _brace_step(s: Column, t: Column) -> Column:
    """Braces: ``open`` is a stack of the headers whose bodies are open, with the depth outside and the number of ranges
    before them. A body that closes takes the place of the ranges inside it; one that never closes leaves them."""
    top = F.try_element_at(s["open"], F.lit(-1))
    ends = ~t["head"] & (t["by"] == -1) & F.coalesce(s["depth"] - 1 == top["depth"], F.lit(False))
    found = F.struct(top["s"].alias("s"), (s["off"] + t["n"]).alias("e"), top["ls"].alias("ls"), (s["line"] + t["nl"]).alias("le"), top["head"].alias("head"))
    opened = F.struct(s["depth"].alias("depth"), s["off"].alias("s"), s["line"].alias("ls"), F.size(s["out"]).alias("n"), t["text"].alias("head"))
    depth = F.greatest(s["depth"] + t["by"], F.lit(0))  # a stray closing brace outside methods doesn't count
    return F.struct((s["off"] + t["n"]).alias("off"), (s["line"] + t["nl"]).alias("line"), depth.alias("depth"),
                    F.when(t["head"], F.concat(s["open"], F.array(opened))).when(ends, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]).alias("open"),
                    F.when(ends, F.concat(F.slice(s["out"], F.lit(1), top["n"]), F.array(found))).otherwise(s["out"]).alias("out"))


def _brace_ranges(cut: str, step, facts) -> Column:
    zero = F.struct(F.lit(0).alias("off"), F.lit(1).alias("line"), F.lit(0).alias("depth"), F.array().cast(_OPEN).alias("open"), F.array().cast(_RANGE).alias("out"))
    return F.aggregate(_tokens(cut, facts), zero, step, lambda s: s["out"])


def _end_facts(t: Column) -> dict[str, Column]:
    return {"by": t.rlike(r"\bend\z")}


def _end_step(s: Column, t: Column) -> Column:
    """Ruby: the first ``end`` closes; ``open`` is 0 inside a method."""
    starts, ends = t["head"] & (s["open"] == -1), ~t["head"] & (s["open"] == 0) & t["by"]
    return _state(s, t, starts, ends, _emit(s, s["off"] + t["n"], s["line"] + t["nl"]), open=F.when(starts, 0).when(ends, -1).otherwise(s["open"]))


def _indent_facts(t: Column) -> dict[str, Column]:
    stripped = F.regexp_replace(t, r"\s+\z", "")
    count = lambda cs: F.char_length(t) - F.char_length(F.translate(t, cs, ""))
    return {"solid": t.rlike(r"\A[ \t\f]*+[^\s#]"), "indent": F.char_length(F.regexp_extract(t, r"\A([ \t]*)", 1)), "last": F.char_length(stripped),
            "last_nl": _newlines(stripped), "by": count("([{") - count(")]}")}


def _indent_step(s: Column, t: Column) -> Column:
    """Python: ``open`` is -2 - the indent of the running method, ``depth`` that of the brackets; e, le are the end of its
    last line with code. A header starts at depth 0, whatever was left open before it."""
    inside = s["open"] <= -2
    ends = inside & t["solid"] & ~t["rest"] & (t["head"] | (s["depth"] == 0)) & (t["indent"] <= -2 - s["open"])
    starts = t["head"] & (ends | ~inside)
    goes_on = starts | (inside & ~ends & t["solid"])
    return _state(s, t, starts, ends, _emit(s, s["e"], s["le"]), open=F.when(starts, -2 - t["indent"]).when(ends, -1).otherwise(s["open"]),
                  depth=F.when(t["head"], F.lit(0)).otherwise(F.greatest(s["depth"] + t["by"], F.lit(0))),
                  e=F.when(goes_on, s["off"] + t["last"]).otherwise(s["e"]), le=F.when(goes_on, s["line"] + t["last_nl"]).otherwise(s["le"]))


# how a block style finds ranges: what can close a method, the fold, the facts that it needs
_BLOCKS = {"brace": (_brace_ranges, r"(?<=[{}])", _brace_step, _brace_facts), "end": (_line_ranges, r"(?<=\bend)\b", _end_step, _end_facts),
           "indent": (_line_ranges, r"(?<=\n)", _indent_step, _indent_facts)}


def _ranges(block: str) -> Column:
    find, *how = _BLOCKS[block]
    return find(*how)


def extract_methods(files: DataFrame, languages: list[str] | None = None, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    """Every method of every file: suite, path, language, method_seq, name, body,
    attributes, access_modifier, line_start, line_end, header_line, parameters, return_type.
    ``files`` has suite, path, content and (optionally) language; ``rules`` replaces the rule table (UF2)."""
    rules = rules or LR.RULES
    files = _known(files, rules)
    if languages:
        files = files.filter(F.col("language").isin(languages))
    acts = {k: r.acts_as or k for k, r in rules.items()}
    ranges = _lang_case({k: _ranges(r.block) for k, r in rules.items()}, F.array().cast(_RANGE))
    up = _lang_case({k: F.lit(LR.DOC_LINES[a]) for k, a in acts.items() if a in LR.DOC_LINES}, F.lit(1))
    window = _lang_case({k: F.lit(LR.DOC_WINDOW[a]) for k, a in acts.items() if a in LR.DOC_WINDOW}, F.lit(0))
    marked = files.select("suite", "path", "language", _text().alias("_text"), _marked(rules).alias("_marked"))
    # the arguments of the inner transform are bound once per file, not once per method
    file = F.struct(F.col("_text").alias("text"), F.split("_text", "\n", -1).alias("lines"), up.alias("up"), window.alias("window"), ranges.alias("ranges"))

    def method(f: Column, m: Column) -> Column:
        above = F.slice(f["lines"], F.greatest(m["ls"] - f["up"], F.lit(1)), F.least(m["ls"] - 1, f["up"]))
        first = F.filter(F.transform(above, lambda x: F.trim(x)), lambda x: x.rlike(r"\S"))
        return F.struct(
            m["ls"].alias("line_start"), m["le"].alias("line_end"), m["head"].alias("head"),
            strip_ws(F.substring(f["text"], m["s"] + 1, m["e"] - m["s"])).alias("body"),
            F.coalesce(F.try_element_at(first, F.lit(1)), F.lit("")).alias("doc_line"),
            F.substring(f["text"], F.greatest(m["s"] - f["window"], F.lit(0)) + 1, F.least(m["s"], f["window"])).alias("doc"))

    methods = F.flatten(F.transform(F.array(file), lambda f: F.transform(f["ranges"], lambda m: method(f, m))))
    rows = marked.select("suite", "path", "language", F.posexplode(methods).alias("_i", "m"))
    m = rows.select("suite", "path", "language", (F.col("_i") + 1).cast("long").alias("method_seq"), "m.*")
    for f in ("name", "modifiers", "receiver", "attrs", "params", "return_type"):
        m = m.withColumn(f, _field(rules, f, F.col("head")))
    m = m.withColumn("hidden_attrs", _field(rules, "attrs", F.col("head"), show=False))
    m = (m.withColumn("header_line", F.col("line_start") + _newlines(F.col("attrs")))
         .withColumn("header_text", F.replace(_shown(F.col("head")), F.col("attrs"), F.lit("")))
         .withColumn("parameters", _parameters(acts)).withColumn("return_type", F.trim("return_type")))
    return m.withColumn("attributes", attributes(acts)).withColumn("access_modifier", access_modifier(acts)).select(
        "suite", "path", "language", "method_seq", "name", "body", "attributes", "access_modifier", "line_start", "line_end", "header_line",
        "parameters", "return_type", "header_text")


def _as(acts: dict[str, str], values: dict[str, Column], default: Column) -> Column:
    """``values`` by the language whose rules a language follows."""
    return _lang_case({k: values[a] for k, a in acts.items() if a in values}, default)


def _parameters(acts: dict[str, str]) -> Column:
    """Python: the names, ``*args`` and ``**kwargs`` included, without annotations and defaults; others as written."""
    p = F.regexp_replace("params", r"\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*", "")
    for _ in range(3):
        p = F.regexp_replace(p, r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}", "")
    names = F.filter(F.transform(F.split(p, ",", -1), lambda x: F.regexp_extract(x, r"^\s*(\*{0,2}\w+)", 1)), lambda x: x != "")
    return _as(acts, {"python": F.array_join(names, ", ")}, F.col("params"))


def attributes(acts: dict[str, str]) -> Column:
    """Attributes per language."""
    name, mods, doc = F.col("name"), F.col("modifiers"), F.rtrim("doc")
    found = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    python = F.filter(F.transform(F.split("hidden_attrs", r"\n(?=[ \t]*@)", -1), lambda t: strip_ws(t)), lambda t: t != "")
    java = F.regexp_extract_all("hidden_attrs", F.lit(r"(@\w+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?)"), 1)
    csharp = F.regexp_extract_all("hidden_attrs", F.lit(r"(\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\])"), 1)
    go = found(F.when(F.col("receiver") != "", F.concat(F.lit("receiver: "), F.trim("receiver"))),
               F.when(F.col("doc_line").startswith("//"), F.lit("// documented")),
               F.when(name.startswith("Test"), F.lit("test")).when(name.startswith("Benchmark"), F.lit("benchmark"))
               .when(name.startswith("Example"), F.lit("example")))
    javascript = found(F.when(F.regexp_replace(doc, r"\s+$", "").endswith("*/"), F.lit("/**...*/")), F.when(mods.contains("async"), F.lit("async")),
                       F.when(mods.contains("static"), F.lit("static")))
    block = F.regexp_extract(F.col("doc"), r"(?s)/\*\*((?:(?!\*/).)*+)\*/\s*$", 1)
    php = F.concat(F.transform(F.regexp_extract_all(block, F.lit(r"@(\w+)"), 1), lambda t: F.concat(F.lit("@"), t)),
                   found(F.when(mods.contains("static"), F.lit("static")), F.when(mods.contains("final"), F.lit("final")),
                         F.when(mods.contains("abstract"), F.lit("abstract"))))
    ruby = found(F.when(F.col("doc_line").startswith("#"), F.lit("# documented")),
                 F.when(name.endswith("?"), F.lit("predicate")).when(name.endswith("!"), F.lit("mutating")))
    python, java, csharp = (F.transform(x, _shown) for x in (python, java, csharp))
    return _as(acts, {"python": python, "java": java, "csharp": csharp, "go": go, "javascript": javascript, "php": php, "ruby": ruby},
               F.array().cast("array<string>"))


def access_modifier(acts: dict[str, str]) -> Column:
    """Visibility per language."""
    mods, name = F.col("modifiers"), F.col("name")
    word = lambda *words: F.coalesce(*[F.when(mods.contains(w), F.lit(w)) for w in words], F.lit("public"))
    java = F.coalesce(*[F.when(mods.contains(w), F.lit(w)) for w in ("public", "private", "protected")], F.lit("package"))
    go = F.when(name.rlike("^[A-Z]"), "public").otherwise("private")
    python = F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")
    return _as(acts, {"csharp": word("private", "protected", "internal"), "java": java, "go": go, "python": python,
                      "php": word("private", "protected"), "ruby": word("private", "protected")}, F.lit("public"))


# ---------------- P1-P4, T1-T4 ----------------

def is_test(methods: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> Column:
    """An attribute or the header text matches a marker (case-insensitive), or
    the name does; Python also by the ``test_`` prefix (V1)."""
    conds = {}
    for lang, r in (rules or LR.RULES).items():
        mk = LR.marker_regex(r)
        c = (F.exists("attributes", lambda a: a.rlike(mk)) | F.col("header_text").rlike(mk) | F.col("name").rlike(mk))
        if (r.acts_as or lang) == "python":
            c = c | F.col("name").startswith("test_")
        conds[lang] = c
    return _lang_case(conds, F.lit(False))


def filter_tests(methods: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    return methods.filter(is_test(methods, rules))


def has_mock(text: Column, rules: dict[str, LR.LangRules] | None = None) -> Column:
    """The text matches any mock filter of its language (one alternation)."""
    return _lang_case({lang: text.rlike(LR.mock_regex(r)) for lang, r in (rules or LR.RULES).items()}, F.lit(False))


def filter_mocks(methods: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    return methods.filter(has_mock(F.col("body"), rules))


def mock_subject(line: Column, rules: dict[str, LR.LangRules] | None = None) -> Column:
    """Subject of a mock line — the language's strategies in order, first
    hit wins; languages without a strategy keep the trimmed line (V7).  Empty
    string means no subject."""
    vals = {}
    for lang, r in (rules or LR.RULES).items():
        src = F.trim(line) if r.subject_on_stripped else line
        if r.subject_patterns:
            e = None
            for p in r.subject_patterns:
                v = F.regexp_extract(src, p, 1)
                e = F.when(v != "", F.trim(v)) if e is None else e.when(v != "", F.trim(v))
            vals[lang] = e.otherwise(F.lit(""))
        else:
            vals[lang] = F.trim(line)
    return _lang_case(vals, F.lit(""))


def mock_lines(methods: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    """P3 exploded: (suite, path, method_seq, pos, line, subject) for lines with a mock."""
    x = methods.select("suite", "path", "language", "method_seq", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    x = x.filter(has_mock(F.col("line"), rules))
    return x.withColumn("subject", mock_subject(F.col("line"), rules))


def strip_to_interactions(methods: DataFrame, rules: dict[str, LR.LangRules] | None = None) -> DataFrame:
    """Body replaced by the newline-joined subjects of its mock lines, in line
    order; methods with none keep an empty body.  Row-local higher-order
    functions: no explode, no join back."""
    subjects = F.transform(F.filter(F.split("body", "\n", -1), lambda l: has_mock(l, rules)), lambda l: mock_subject(l, rules))
    return methods.withColumn("body", F.array_join(F.filter(subjects, lambda s: s != ""), "\n"))


def to_extracted(methods: DataFrame) -> DataFrame:
    """T4 + D6: the (suite, method_seq, name, code) records the analysis reads."""
    return methods.select("suite", "path", "method_seq", "name", clean_code("body").alias("code"))


def language_stats(methods: DataFrame) -> DataFrame:
    """Methods per language."""
    return methods.groupBy("language").agg(F.count("*").alias("n_methods"))


def supported_languages(spark, files: DataFrame | None = None) -> DataFrame:
    """Languages with a rule set (restricted to those present in ``files``)."""
    rules = LR.rules_frame(spark).select("language").distinct()
    if files is None:
        return rules
    present = detect_language(files).select("language").distinct()
    return rules.join(present, "language")
