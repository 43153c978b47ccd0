"""Quality rules against plain Python on odd and ordinary texts."""

import random
import re
from collections import Counter

from muster.llm import quality_rules
from muster.llm.quality_rules import Rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
RULES = Rules()


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = text.split("\n")
    worded = [x for x in lines if WORD.search(x)]
    fails = [x for x in lines if re.search(RULES.punctuation.replace(r"\z", r"\Z"), x) or re.search(RULES.navigation, x)
             or (len(x) <= RULES.notice_chars and re.search(RULES.boilerplate, x, re.A))]
    chars = sum(map(len, words))
    lost = sum(len(BLANK.sub("", x)) for x in fails) / chars if chars else 0.0
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(repeated),
            failed, not failed and lost <= RULES.most_lost)


def texts():
    rng = random.Random(9)
    found = [None, "", " \n\t ", "word", "a b c d e " * 4, "x y z " * 12, "é" * 5000, "one " * 3000,
             "line\nline\nline\n\n \n", "A!! B!! C!! " * 9, "a | b | c | d and more of it to read here\n" + "Good text. " * 3,
             "Subscribe to our newsletter\nThis is some text with more than ten words in it, all of them good.",
             "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w1 w2 w3 w4 w5", "a## b$$ c%%\r\nd"]
    for _ in range(80):
        line = lambda: " ".join(rng.choice(["the", "of", "Éa.", "b!!", "c$$", "|", "home", "cookie", "x&&", "yes,"])
                                for _ in range(rng.randint(0, 12)))
        found.append("\n".join(line() for _ in range(rng.randint(1, 6))))
    return found


def test_equals_plain_python(spark):
    rows = [(k, t, "old") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, kept string").repartition(3)
    found = quality_rules.judge(docs)
    got = [(r.doc_id, tuple(r[c] for c in [*quality_rules.COUNTS, "base_failed", "kept"])) for r in found.collect()]
    assert sorted(got) == sorted((k, slow(t)) for k, t, _ in rows + rows[:3])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, t, _ in rows + rows[:3] if slow(t)[-1])
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_failing_lines_are_removed(spark):
    text = "First good line.\nHome | News | Sport | More\nLast good line."
    docs = spark.createDataFrame([(text,), (None,)], "text string")
    assert {r.clean_text for r in quality_rules.judge(docs).collect()} == {"First good line.\nLast good line.", ""}
