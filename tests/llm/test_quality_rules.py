from collections import Counter

from panelforge.llm import quality_rules
from tests.llm import edge

SPACES = " \t\n\v\f\r"


def split(text):
    out = [""]
    for c in text or "":
        if c in SPACES:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def brute(text):
    words = split(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if split(line)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


def test_counts_match_brute_force(spark):
    rows = [
        (1, "a b c d e f g h " * 3 + "x", "en", "s"),
        (2, "one two three\none two three\n\n \none two three\r", "en", "s"),
        (3, "a\v\fb # * $ % & | < > \u00a0c", "en", "s"),
        (4, " ".join(f"w{k % 9}" for k in range(40)), "en", "s"),
    ]
    for frame in (edge.docs(spark, rows), edge.docs(spark)):
        found = quality_rules.judge(edge.clash(frame, "n_words", "kept"))
        assert len(found.columns) == len(set(found.columns))
        for r in found.collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert (*got, r.base_failed) == brute(r.text)
            assert not (r.base_failed and r.kept)


def test_rules_are_a_table(spark):
    rows = [(1, edge.ENGLISH, "en", "s"), (2, "| " * 30 + edge.ENGLISH, "en", "s")]
    found = {r.doc_id: r for r in quality_rules.judge(edge.docs(spark, rows)).collect()}
    assert found[1].kept and found[1].broken == []
    assert not found[2].kept and "symbols" in found[2].broken
    strict = (quality_rules.Rule("none", 1, "n_words", ">", 0, "one"),)
    assert quality_rules.judge(edge.docs(spark, rows), rules=strict).where("kept").count() == 0


def test_empty_table(spark):
    assert quality_rules.judge(edge.docs(spark, [])).count() == 0
