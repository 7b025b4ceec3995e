import re

from epigrain.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    good = [
        x
        for x in lines
        if re.search(rules.SENTENCE_END, x)
        and rules.SYMBOL_RATE * sum(c in rules.SYMBOLS for c in x) <= sum(map(len, WORD.findall(x)))
        and len(re.findall(rules.SEPARATOR_WORD, re.sub(rules.SPACE_RUN, "  ", x))) < rules.MAX_SEPARATORS
        and not (re.search(rules.NOTICE, x.lower()) and len(WORD.findall(x)) < rules.NOTICE_WORDS)
    ]
    chars = sum(map(len, words))
    left = sum(len(w) for x in good for w in WORD.findall(x))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(c in rules.SYMBOLS for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
        "kept": not failed and 100 * (chars - left) <= 50 * chars,
        "clean_text": "\n".join(good),
    }


def test_counts_and_verdicts_match_a_plain_version(documents):
    prose = "This is a plain sentence of some length, as found in books. Another one follows it here.\n"
    texts = [
        None, "", " \n\t", "one two", prose, prose + prose, prose * 3, "a b c d e " * 30, "word " * 4000,
        prose + "Home | About | Contact | Help\nAll rights reserved.\n", "Home | News | Sport\nA > B > C\n" + prose,
        "no end of sentence in this line at all, it goes on\n" * 2 + prose, "x#*$%&|<> y", "ab%%% cd*** ef. " * 9, "été l'école № 5.\r\nÀ bientôt!\x0bOui… «oui.»\n",
        "Accept cookies\n" + prose, "\x1cnot\x1ca space", "same line here.\nsame line here.\nother line here.",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "repeated id, with its own text. It has more than ten words in it.")]
    got = rules.judge(documents(rows)).collect()
    assert len(got) == len(rows)
    texts_of = {}
    for doc_id, t in rows:
        texts_of.setdefault(doc_id, []).append(plain(t))
    for r in got:
        assert {k: r[k] for k in plain("")} in texts_of[r.doc_id], r


def test_empty_table(documents):
    assert rules.judge(documents([])).count() == 0


def test_plan_has_no_python(documents, capsys):
    rules.judge(documents([(1, "a")])).explain()
    assert "Python" not in capsys.readouterr().out


def test_sentences_of_other_scripts_end_too(documents):
    texts = ["यह एक साफ वाक्य है जिसमें काफी शब्द हैं और यह ठीक है।", "هذه جملة نظيفة فيها كلمات كثيرة و هي جيدة جدا هنا؟", "一 二 三 四 五 六 七 八 九 十 这是一个句子。", "no end of a sentence in this line of ten words at all"]
    rows = {r.doc_id: r.kept for r in rules.judge(documents(list(enumerate(texts)))).collect()}
    assert [rows[i] for i in range(4)] == [True, True, True, False]
