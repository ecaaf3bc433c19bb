"""License scans: ordered signature rules over the words of each text, in DataFrame expressions alone.

A rule has a keyword, a regular expression over the text's words (lower case, one blank between words), a label, a
priority and a confidence. A text is taken apart only if a keyword (the words of one in a row) stands in it; a rule is
tried only if its own keyword does, and then the longest literal of its regular expression. Where detections overlap, one that lies within the interval of a better one (higher priority, then
longer, then earlier rule) is suppressed. There are a few hundred rules; most are made from families and versions.

Everything is one projection: no shuffle, no state beyond a row.

Defined cases: a null text is empty: no words, no labels, score 0. Empty and long texts are rows like others, and a text of
many detections takes time in proportion to them but for the power 1.5 of those of one rule (a list of all detections, which
the query leaves out, is copied for each). Repeated rows and clashing column names make no difference, since only doc_id
and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base phrases and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words: runs of anything but the ASCII characters that are neither digits nor letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The keywords, each the beginning of words in a row.
KEYWORDS = (
    "licen", "spdx", "cc by", "cc0", "cc zero", "creative commons", "creativecommons", "gpl", "lgpl", "agpl", "apache", "mpl", "epl", "eupl", "cddl", "cpl", "osl", "afl", "cecill", "lppl", "ofl", "zpl", "odbl", "bsd",
    "mit 0", "mit no", "unlicense", "wtfpl", "public domain", "free and unencumbered", "permission is hereby", "permission to use", "all rights reserved", "proprietary", "redistribution is", "redistribution strictly", "redistribution prohibited",
)
ACRONYMS = frozenset("cc0 gpl lgpl agpl mpl epl eupl cddl cpl osl afl cecill lppl ofl zpl odbl bsd wtfpl".split())


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    needle: str
    regex: str
    priority: int
    confidence: float


def needle(regex: str) -> str:
    """The longest literal that every match of a rule's regex holds: what is in no group, class or optional part."""
    found, part, at = [], "", 0
    while at < len(regex):
        c = regex[at]
        if c in "([":
            depth, close = 1, {"(": ")", "[": "]"}[c]
            while depth:
                at += 1
                depth += (regex[at] == c) - (regex[at] == close)
            c = ""
        elif c == "\\":
            at, c = at + 1, ""
        optional = at + 1 < len(regex) and regex[at + 1] in "?*{"
        if c and c.isalnum() or c == " ":
            part += "" if optional else c
            c = "" if optional else c
        else:
            c = ""
        if not c:
            found.append(part)
            part = ""
        at += 1
    return max([*found, part], key=len).strip()


def _spdx(words: str) -> str:
    return f"spdx license identifier {words}"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order. Regexes see ' word word ... word '; each begins and ends at a blank."""
    made: list[Rule] = []

    def rule(label: str, keyword: str, regex: str, priority: int, confidence: float) -> None:
        assert keyword in KEYWORDS, keyword
        made.append(Rule(f"{label}#{len(made)}", label, keyword, needle(regex), f" {regex}(?= )", priority, confidence))

    # Creative Commons: six licences, five versions, long and short names, ported or not, deed addresses
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative work|s|ative works)?"}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        codes, names = kind.replace("-", " "), " ".join(parts[k] for k in kind.split("-"))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            rule(label, "cc by", f"cc {codes} {version}", 80, 0.95)
            rule(label, "creative commons", f"creative commons {names} {version}(?: international| unported| generic)?(?: public)?(?: license| licence)?", 85, 1.0)
            rule(label, "creativecommons", f"creativecommons org licenses {codes} {version}(?: legalcode)?", 90, 1.0)
        rule(f"cc-{kind}", "cc by", f"cc {codes}", 60, 0.8)
        rule(f"cc-{kind}", "creative commons", f"creative commons {names}", 60, 0.8)
    for keyword, words in (("cc0", "cc0"), ("cc zero", "cc zero"), ("cc0", "cc0 1 0"), ("creative commons", "creative commons zero"), ("cc0", "cc0 1 0 universal"), ("creativecommons", "creativecommons org publicdomain zero 1 0")):
        rule("cc0-1.0", keyword, words, 80 + len(words.split()), 0.95)

    # the GNU licences: name or initials, versions, "or later" and "only", SPDX forms
    gnu = {"gpl": ("general public license", ("1", "2", "3")), "lgpl": ("(?:lesser|library) general public license", ("2", "2 1", "3")), "agpl": ("affero general public license", ("1", "3"))}
    for label, (name, versions) in gnu.items():
        for version in versions:
            dotted, short = version.replace(" ", "."), version + ("(?: 0)?" if " " not in version else "")
            for tail, ending in (("or-later", "(?: of the license)? or (?:at your option )?any later(?: version)?"), ("or-later", " or later"), ("only", " only"), ("", "")):
                full = f"{label}-{dotted}" + (f"-{tail}" if tail else "")
                weight = 5 if tail else 0
                rule(full, "licen", f"(?:gnu )?{name}(?: as published by the free software foundation)?(?: either)? version {short}{ending}", 85 + weight, 1.0)
                rule(full, label, f"(?:gnu )?{label} (?:version )?v?{short}{ending}", 80 + weight, 0.95)
            rule(f"{label}-{dotted}", "licen", f"(?:gnu )?{name} v{short}", 80, 0.95)
            rule(f"{label}-{dotted}", label, f"{label}{version.replace(' ', '(?: )?')}", 70, 0.85)
            for tail in ("", " only", " or later"):
                rule(f"{label}-{dotted}{tail.replace(' ', '-')}", "spdx", _spdx(f"{label} {short}{tail}"), 95, 1.0)
        rule(label, "licen", f"(?:gnu )?{name}", 60, 0.9)
        rule(label, label, f"(?:gnu )?{label}(?: license)?", 50, 0.7)

    # licences with versions
    families = (
        ("apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla public", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse public", ("1 0", "2 0")),
        ("eupl", "european union public", ("1 0", "1 1", "1 2")),
        ("cddl", "common development and distribution", ("1 0", "1 1")),
        ("cpl", "common public", ("1 0",)),
        ("artistic", "artistic", ("1 0", "2 0")),
        ("osl", "open software", ("1 0", "2 0", "2 1", "3 0")),
        ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        ("boost", "boost software", ("1 0",)),
        ("cecill", "cecill(?: free software)?", ("1 0", "1 1", "2 0", "2 1")),
        ("lppl", "latex project public", ("1 0", "1 1", "1 2", "1 3")),
        ("ofl", "(?:sil )?open font", ("1 0", "1 1")),
        ("zpl", "zope public", ("1 1", "2 0", "2 1")),
        ("php", "php", ("3 0", "3 01")),
        ("python", "python software foundation", ("2 0",)),
        ("odbl", "open (?:data commons open )?database", ("1 0",)),
    )
    for label, name, versions in families:
        for version in versions:
            short = version.removesuffix(" 0") + ("(?: 0)?" if version.endswith(" 0") else "")
            dotted = f"{label}-{version.replace(' ', '.')}"
            rule(dotted, "licen", f"{name} licen[sc]e(?: the)? (?:version |v)?{short}", 85, 1.0)
            # a name that is a word of its own needs "license" beside it
            if label in KEYWORDS:
                rule(dotted, label, f"{label} (?:license )?(?:version |v)?{short}", 70, 0.85)
            rule(dotted, "spdx", _spdx(f"{label} {short}"), 95, 1.0)
        rule(label, "licen", f"{name} licen[sc]e", 60, 0.9)
    rule("apache-2.0", "apache", "apache org licenses license 2 0", 85, 1.0)

    # BSD by its number of clauses
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        rule(f"bsd-{n}-clause", "bsd", f"bsd (?:{n}|{word}) clause(?: licen[sc]e)?", 80, 0.95)
        rule(f"bsd-{n}-clause", "bsd", f"(?:{n}|{word}) clause bsd(?: licen[sc]e)?", 80, 0.95)
        rule(f"bsd-{n}-clause", "spdx", _spdx(f"bsd {n} clause"), 95, 1.0)
    rule("bsd-2-clause", "bsd", "simplified bsd licen[sc]e", 75, 0.9)
    rule("bsd-2-clause", "licen", "freebsd licen[sc]e", 75, 0.9)
    rule("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd licen[sc]e", 75, 0.9)
    rule("bsd-4-clause", "bsd", "(?:original|old) bsd licen[sc]e", 75, 0.9)
    rule("bsd", "bsd", "bsd(?: style)? licen[sc]e", 60, 0.8)

    # MIT and short permissive licences
    rule("mit", "licen", "(?:released |licensed )?under the (?:terms of the )?mit licen[sc]e", 85, 1.0)
    rule("mit", "licen", "(?:the )?mit(?: x11)? licen[sc]e", 60, 0.95)
    rule("mit", "spdx", _spdx("mit"), 95, 1.0)
    rule("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 90, 1.0)
    rule("mit-0", "mit 0", "mit 0(?: licen[sc]e)?", 80, 0.95)
    rule("mit-0", "mit no", "mit no attribution(?: licen[sc]e)?", 80, 0.95)
    rule("isc", "licen", "isc licen[sc]e", 80, 0.95)
    rule("isc", "permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 90, 1.0)
    rule("zlib", "licen", "zlib(?: libpng)? licen[sc]e", 80, 0.95)
    rule("libpng", "licen", "libpng licen[sc]e", 75, 0.9)
    rule("wtfpl", "licen", "do what the \\w+ you want to public licen[sc]e", 85, 1.0)
    rule("wtfpl", "wtfpl", "wtfpl(?: version 2)?", 70, 0.85)
    rule("unlicense", "unlicense", "(?:the )?unlicense", 80, 0.9)
    rule("unlicense", "free and unencumbered", "free and unencumbered software released into the public domain", 90, 1.0)
    rule("public-domain", "public domain", "(?:released |dedicated |placed )?(?:into|to|in) the public domain", 60, 0.8)
    rule("public-domain", "public domain", "public domain(?: dedication)?", 50, 0.6)
    rule("beerware", "licen", "beer ?ware licen[sc]e", 80, 0.95)
    rule("postgresql", "licen", "postgresql licen[sc]e", 80, 0.95)
    rule("openssl", "licen", "openssl licen[sc]e", 80, 0.95)
    rule("ncsa", "licen", "(?:university of illinois )?ncsa open source licen[sc]e", 80, 0.95)
    rule("vim", "licen", "vim licen[sc]e", 75, 0.9)
    rule("curl", "licen", "curl licen[sc]e", 75, 0.9)
    rule("fair", "licen", "fair licen[sc]e", 70, 0.8)
    rule("proprietary", "all rights reserved", "all rights reserved", 50, 0.6)
    rule("proprietary", "proprietary", "proprietary (?:and confidential|licen[sc]e|software)", 60, 0.7)
    for keyword in ("redistribution is", "redistribution strictly", "redistribution prohibited"):
        rule("proprietary", keyword, f"{keyword}(?: strictly)?(?: prohibited)?(?<=prohibited)", 60, 0.7)
    for words in ("licensed under", "released under", "distributed under", "available under", "made available under", "published under"):
        rule("licence-statement", "licen", f"{words} (?:the|a|an)?(?: ?\\w+){{0,3}} ?licen[sc]e", 40, 0.5)
    return tuple(made)


def _gate() -> str:
    """A regex over the raw text that any text with a detection matches: a keyword's words in a row, or a base phrase."""
    # an acronym ends there or goes on with a digit; other keywords may begin a longer word
    inside, between = r"(?<![0-9A-Za-z\x{80}-\x{10FFFF}])", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"(?i){inside}(?:{'|'.join(between.join(k.split()) + (r"(?![A-Za-z\x{80}-\x{10FFFF}])" if k in ACRONYMS else "") for k in KEYWORDS)})"


def _rule_map() -> Column:
    """The rules by keyword, as one literal."""
    by: dict[str, list[dict]] = {k: [] for k in KEYWORDS}
    for i, r in enumerate(rules()):
        by[r.keyword].append({"order": i, "label": r.label, "needle": r.needle, "regex": r.regex, "priority": r.priority, "confidence": r.confidence})
    return F.from_json(F.lit(json.dumps(by)), "map<string,array<struct<order:int,label:string,needle:string,regex:string,priority:int,confidence:double>>>")


def _starts(words: Column, phrase: str) -> Column:
    """The places, words from 0, where a phrase's words stand one after another."""
    parts = phrase.split()
    places = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))
    hit = lambda i: (F.get(words, i) == parts[0]) & _rest(words, parts, i)
    return F.filter(places, hit)


def _rest(words: Column, parts: list[str], i: Column) -> Column:
    found = F.lit(True)
    for k, part in enumerate(parts[1:], 1):
        found = found & (F.get(words, i + k) == part)
    return found


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(steps: Column, start: Column) -> Column:
    """Running sums from start, each step included; the list is copied for each, so steps are few."""
    state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
    step = lambda s, x: _let(s["at"] + x, lambda to: F.struct(to.alias("at"), F.concat(s["sums"], F.array(to)).alias("sums")))
    return F.aggregate(steps, state, step, lambda s: s["sums"])


def _sums(steps: Column) -> Column:
    """Running sums of many steps, by parts of about the square root of their number."""

    def parts(steps: Column, n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / n).cast("int")), lambda k: F.slice(steps, k * n + 1, n))

        def joined(cut: Column) -> Column:
            totals = F.transform(cut, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
            return F.flatten(F.zip_with(cut, F.concat(F.array(F.lit(0)), _running(totals, F.lit(0))), lambda p, at: _running(F.coalesce(p, F.array().cast("array<int>")), at)))

        return _let(cut, joined)

    return _let(steps, lambda x: F.when(F.size(x) > 0, parts(x, F.ceil(F.sqrt(F.size(x))).cast("int"))).otherwise(F.array().cast("array<int>")))


def _detections(norm: Column, keywords: Column) -> Column:
    """Every match of every rule whose keyword is among the text's, in the order in which they are settled: begin, falling
    end and priority, rule; places in characters."""

    def one(rule: Column) -> Column:
        def spans(found: Column, between: Column) -> Column:
            gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x))
            hits = F.transform(found, lambda x: F.length(x))
            ends = _sums(F.zip_with(gaps, hits, lambda x, y: F.coalesce(x, F.lit(0)) + y))
            # the blank before the words is part of the match
            return F.zip_with(ends, hits, lambda end, size: F.struct((end - size + 1).alias("begin"), (-end).alias("end"), (-rule["priority"]).alias("priority"), rule["order"].alias("order"), rule["label"].alias("label"), rule["confidence"].alias("confidence")))

        return _let(F.regexp_extract_all(norm, rule["regex"], F.lit(0)), lambda found: spans(found, F.split(norm, rule["regex"])))

    tried = F.flatten(F.transform(keywords, lambda k: F.element_at(_rule_map(), k)))
    return F.array_sort(F.flatten(F.transform(F.filter(tried, lambda r: F.contains(norm, r["needle"])), one)))


def _standing(detections: Column, spans: bool) -> Column:
    """labels (distinct), score and, with spans, detections that no better one contains.

    In the order of detections one that contains another comes first if it is better or has the higher priority. So a
    detection stands if it ends beyond all before it of its priority or a higher one: of each priority the farthest end is kept.
    """
    levels = sorted({r.priority for r in rules()})
    kept = "array<struct<label:string,begin:int,end:int>>"
    start = F.struct(F.array(*[F.lit(0)] * len(levels)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.array().cast(kept).alias("kept"))

    def step(s: Column, d: Column) -> Column:
        level = F.array_position(F.array(*map(F.lit, levels)), -d["priority"]).cast("int")
        stands = F.get(s["ends"], level - 1) < -d["end"]

        def stand(_: Column) -> Column:
            ends = F.transform(s["ends"], lambda end, k: F.when(k < level, F.greatest(end, -d["end"])).otherwise(end))
            labels = F.when(F.array_contains(s["labels"], d["label"]), s["labels"]).otherwise(F.concat(s["labels"], F.array(d["label"])))
            more = F.concat(s["kept"], F.array(F.struct(d["label"].alias("label"), d["begin"].alias("begin"), (-d["end"]).alias("end")))) if spans else s["kept"]
            return F.struct(ends.alias("ends"), labels.alias("labels"), F.greatest(s["score"], d["confidence"]).alias("score"), more.alias("kept"))

        return F.when(stands, stand(s)).otherwise(s)

    return F.aggregate(detections, start, step)


def scan_licenses(docs: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and (with spans) detections of every document.

    score is the greatest confidence of a detection that stands, 0 without one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    base = docs.select(F.col("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("_text").rlike(_gate()), F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(WORD), F.lit(0))).otherwise(none).alias("_words"),
    )
    words = F.col("_words")
    labelled = [_labelled(_starts(words, phrase), label) for phrase, label in BASE.items()]
    # a column of its own: within the rules' lambdas it would be joined again for each rule
    base = base.withColumn("_norm", F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))))
    base = base.withColumn("_keywords", F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.col("_norm"), F.concat(F.lit(" "), k))))
    places = F.when(F.size(words) > 0, F.concat(*labelled)).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
    standing = F.when(F.size(words) > 0, _standing(_detections(F.col("_norm"), F.col("_keywords")), spans))
    found = base.select("doc_id", "n_words", places.alias("_base"), standing.alias("_standing"))
    base_labels = F.array_distinct(F.transform("_base", lambda b: b["label"]))
    labels = F.concat(base_labels, F.coalesce(F.col("_standing.labels"), none))
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.coalesce(F.col("_standing.score"), F.lit(0.0)).alias("score"),
        *([F.coalesce(F.col("_standing.kept"), F.array().cast("array<struct<label:string,begin:int,end:int>>")).alias("detections")] if spans else []),
    )
