"""The Russian Snowball stemmer (published algorithm), for distinct words of a vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: endings of the published algorithm -----------------------------------------------------------
VOWELS = "аеиоуыэюя"
PERFECTIVE_GERUND_1 = ("вшись", "вши", "в")
PERFECTIVE_GERUND_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = ("ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
PARTICIPLE_1 = ("ем", "нн", "вш", "ющ", "щ")
PARTICIPLE_2 = ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
VERB_2 = ("ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю")
NOUN = ("а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я")
DERIVATIONAL = ("ост", "ость")
SUPERLATIVE = ("ейш", "ейше")
# ----------------------------------------------------------------------------------------------------------------


def _ending(after_a: tuple[str, ...], free: tuple[str, ...]) -> re.Pattern:
    """Longest ending; those of the first group only behind а or я."""
    every = sorted([(e, True) for e in after_a] + [(e, False) for e in free], key=lambda x: -len(x[0]))
    return re.compile("(?:" + "|".join((r"(?<=[ая])" if a else "") + e for e, a in every) + ")$")


GERUND, VERB = _ending(PERFECTIVE_GERUND_1, PERFECTIVE_GERUND_2), _ending(VERB_1, VERB_2)
ADJ, PART = _ending((), ADJECTIVE), _ending(PARTICIPLE_1, PARTICIPLE_2)
REFL, NOUNS = _ending((), REFLEXIVE), _ending((), NOUN)
DERIV, SUPER = _ending((), DERIVATIONAL), _ending((), SUPERLATIVE)
REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def stem(word: str) -> str:
    word = word.replace("ё", "е")
    first = re.search(f"[{VOWELS}]", word)
    if not first:
        return word
    rv = first.end()
    one = REGION.search(word)
    two = REGION.search(word, one.end()) if one else None
    r2 = two.end() if two else len(word)
    head, tail = word[:rv], word[rv:]

    def cut(pattern: re.Pattern, text: str) -> str | None:
        """text without the ending, or None."""
        m = pattern.search(text)
        return text[: m.start()] if m else None

    done = cut(GERUND, tail)
    if done is None:
        short = cut(REFL, tail)
        tail = tail if short is None else short
        done = cut(ADJ, tail)
        if done is not None:
            part = cut(PART, done)
            done = done if part is None else part
        else:
            done = cut(VERB, tail)
            if done is None:
                done = cut(NOUNS, tail)
    tail = tail if done is None else done
    if tail.endswith("и"):
        tail = tail[:-1]
    m = DERIV.search(tail)
    if m and rv + m.start() >= r2:
        tail = tail[: m.start()]
    short = cut(SUPER, tail)
    if tail.endswith("нн"):
        tail = tail[:-1]
    elif short is not None:
        tail = short[:-1] if short.endswith("нн") else short
    elif tail.endswith("ь"):
        tail = tail[:-1]
    return head + tail


@F.pandas_udf(T.StringType())
def stem_word(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")
