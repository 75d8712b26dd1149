"""English stems by the published Snowball rules, as tables of endings that one small interpreter applies.

A word's endings are tried by length, the longest first, as the rules ask; the first that fits decides the step.
"""

from __future__ import annotations

# The stop words of English text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Words that the rules don't apply to, with their stems.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
# Words that are done after the plural step.
FINISHED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Beginnings after which the first region starts.
PREFIXES = ("gener", "commun", "arsen")
VOWELS, DOUBLES, LI_BEFORE = set("aeiouy"), {"bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"}, set("cdeghkmnrt")

# Ending, what stands in its place; all in the first region.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
# Endings that go if they stand in the second region.
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def longest(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


def region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if has_vowel(word[:-2]) else word


def participle(word: str, r1: int) -> str:
    ending = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    rest = word[: -len(ending)]
    if ending.startswith("ee"):
        return rest + "ee" if len(rest) >= r1 else word
    if not has_vowel(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in DOUBLES:
        return rest[:-1]
    return rest + "e" if ends_short(rest) and r1 >= len(rest) else rest


def stem(word: str) -> str:
    """The English stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # y at the start and after a vowel is a consonant
    marked = ""
    for c in word:
        marked += "Y" if c == "y" and (not marked or marked[-1] in VOWELS) else c
    word = marked
    prefix = next((p for p in PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else region(word, 0)
    r2 = region(word, r1)

    word = plural(word)
    if word in FINISHED:
        return word
    word = participle(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    ending = longest(word, STEP_2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l")) and not (ending == "li" and before[-1:] not in LI_BEFORE):
            word = before + STEP_2[ending]
    ending = longest(word, STEP_3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP_3[ending]
    ending = longest(word, STEP_4)
    if ending and len(word) - len(ending) >= r2 and not (ending == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
