"""Small document tables with the awkward cases."""

import random

WORDS = {
    "en": "the of and to in is that with for was on are by this from or house river cloud".split(),
    "de": "der die und das ist nicht mit auf für ein eine schön straße wasser über können".split(),
    "fr": "le la les des est une dans qui pour été sur avec même où maison forêt très".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = (rng.choice(WORDS[lang]) + rng.choice(["", "", "a", "er", "ing"]) for _ in range(n))
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def documents(seed: int = 1, n: int = 90) -> list[tuple]:
    """Prose, exact and near copies, shared passages, empty and null texts, null columns."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, "en", 30)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.choice([1, 3, 8, 40, 90]))
        if i % 9 == 0:
            text += "\n" + passage
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    for k in range(12):
        words = rows[4][1].split() + prose(rng, "fr", 60).split()[: 60 if k == 0 else 0]
        if k % 3:
            words[k % len(words)] = "changed"
        rows.append((n + k, " ".join(words), "fr", "src0", 0))
    long = prose(rng, "de", 4000)
    rows += [(n + 20, long, "de", "src1", 0), (n + 21, long + " Ende", "de", "src1", 0)]
    rows += [(n + 30, None, "en", "src1", None), (n + 31, "", "en", None, 0)]
    rows += [(n + 32, " \n!?", None, "src2", 4), (n + 33, "12345 678", "en", "src2", 9)]
    rows += [(None, rows[3][1], "en", "src0", 0), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (7, "another text under the same id, with a few words", "en", "src1", 0)]
    return rows
