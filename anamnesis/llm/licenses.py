"""Licence statements in texts by a positional index of rare words. DataFrame functions only.

A template is a licence's usual notice, with the key phrases without which it does not count.
Texts are cut into words once: what is kept of them is the places of licence words, as numbers. The rarity of
a licence word is its inverse document frequency over all texts.

The rarest words of a template's key phrases are looked up among a text's places; place minus position
is where the template would start. The starts that all of these words agree on are verified: the
key phrases must stand there in full, so other texts have no say in it. The template's other rare words
count for the score.

Base places, where a phrase's words stand one after another, are found through the same index:
the phrases are templates of their own whose every word must agree.

The places of a text stay one array in its row, and only (word, text count) pairs of licence words are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut_lineage

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE_WORDS = 4

BASE_PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Template:
    """A licence's sentence and its mandatory phrases, as lower-case words."""

    label: str
    words: str
    key_phrases: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of "
             "this software and associated documentation files to deal in the software without restriction", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files to deal in the software without restriction including without limitation the rights to use copy "
             "modify merge publish distribute sublicense and or sell copies of the software",
             ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license you may obtain a copy of the license", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2 this program is distributed in the hope that it will "
             "be useful but without any warranty", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3 this program is distributed in the hope that it will "
             "be useful but without any warranty", ("general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
             "file you can obtain one at", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met redistributions of source code must retain the above copyright notice",
             ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
             "granted provided that the above copyright notice and this permission notice appear in all copies",
             ("permission to use copy modify and or distribute this software",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc0", "dedicated to the public domain under cc0", ("public domain under cc0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify "
             "publish use compile sell or distribute this software", ("free and unencumbered software",)),
)

#: Words too common to tell a notice: they open no lookup and count for no score, and are kept only for key phrases.
COMMON = frozenset("a an and any as at be but by can following for free if in is it of on one or that the this to under use was will "
                   "with without you".split())


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))


def licence_words(templates: tuple[Template, ...], phrases) -> list[str]:
    """Words whose places are kept: those of phrases, and the others of templates that are not common."""
    needed = {w for t in templates for p in (t.key_phrases or (t.words,)) for w in p.split()} | {w for _, p in phrases for w in p.split()}
    return sorted(needed | {w for t in templates for w in t.words.split() if w not in COMMON})


def licence_places(docs: DataFrame, vocabulary: list[str], id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_words and places: (word, place) of each licence word, the word as its 0-based number in
    the vocabulary, places from 1. Written once, as texts are cut into words only here."""
    words = words_of(F.col(text_column))
    numbers = F.create_map(*(F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), words.alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), (i + 1).alias("place")))),
                  lambda x: x.isNotNull())
    placed = source.select("doc_id", F.size("words").cast("long").alias("n_words"), at.alias("at"))
    numbered = F.transform("at", lambda x: F.struct(F.element_at(numbers, x["word"]).cast("int").alias("word"), x["place"].alias("place")))
    return cut_lineage(placed.select("doc_id", "n_words", numbered.alias("places")))


def rarity(placed: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Texts that hold each licence word, over all texts. At most one row per licence word is shuffled per task."""
    held = F.array_distinct(F.transform("places", lambda x: x["word"]))
    rows = placed.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    known = {vocabulary[r.word]: r.n for r in rows}
    return {w: known.get(w, 0) for w in vocabulary}


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases=BASE_PHRASES,
                  rare_words: int = RARE_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of `docs`.

    Places count words from 0. base_labels come from the phrases, labels also from the templates;
    both are sorted and comma-joined. score is the largest share of a template's rarity that its best verified
    place holds, 1 where only a base phrase was found, 0 where nothing was. A null or empty text
    has no word and no place; a null id stays null; repeated rows are repeated; other columns are ignored.
    """
    vocabulary = licence_words(templates, phrases)
    number = {w: i for i, w in enumerate(vocabulary)}
    placed = licence_places(docs, vocabulary, id_column, text_column)
    frequency = rarity(placed, vocabulary)
    weight = {w: 1.0 / (1.0 + n) for w, n in frequency.items()}  # ranks as the inverse document frequency does
    # A template whose key phrase has a word that no text holds is in no text.
    templates = [t for t in templates if all(frequency[w] for p in t.key_phrases for w in p.split())]

    notices = [_Notice(label, [(0, phrase)], [], number, frequency, weight) for label, phrase in phrases]
    for t in templates:
        words = t.words.split()
        scored = sorted({w for w in words if w in number and w not in COMMON and frequency[w]}, key=lambda w: (frequency[w], w))
        notices.append(_Notice(t.label, _key_offsets(t) or [(0, t.words)], [(w, words.index(w)) for w in scored[:rare_words]],
                               number, frequency, weight))
    # First the postings of the rarest words; nearly all texts have no start that they agree on.
    opened = placed.select("doc_id", "n_words", "places", *(n.opening(rare_words).alias(f"open{i}") for i, n in enumerate(notices)))
    found = [n.places(f"open{i}", rare_words) for i, n in enumerate(notices)]
    base, more = found[:len(phrases)], found[len(phrases):]
    none = F.array().cast(PLACES)
    scanned = opened.select("doc_id", "n_words", F.concat(none, *base).alias("base"), F.concat(none, *more).alias("more"))
    labels_of = lambda name: F.transform(name, lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("more", lambda x: x["score"])), F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    starts = F.transform("base", lambda x: x["start"])
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        (F.array_min(starts) - 1).cast("long").alias("first_word"), (F.array_max(starts) - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels_of("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels_of("base"), labels_of("more"))), ",").alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"))


def _starts(word: int, offset: int) -> Column:
    """Where a notice would start whose word `offset` is `word`, for each place of the word."""
    return F.transform(F.filter("places", lambda x: x["word"] == word), lambda x: x["place"] - offset)


PLACES = "array<struct<start:int,label:string,score:double>>"


class _Notice:
    """Key phrases at their offsets, and rare words of the notice with theirs, for the score."""

    def __init__(self, label: str, keys: list[tuple[int, str]], scored: list[tuple[str, int]], number: dict[str, int],
                 frequency: dict[str, int], weight: dict[str, float]):
        self.label, self.number, self.weight = label, number, weight
        needed = {(w, offset + i) for offset, phrase in keys for i, w in enumerate(phrase.split())}
        self.needed = sorted(needed, key=lambda x: (frequency[x[0]], x))
        self.first = keys[0][0]
        # The rarest key word always counts, so that a verified notice has a share.
        self.scored = sorted({*scored, self.needed[0]}) if scored else []

    def _meet(self, starts: Column | None, words: list[tuple[str, int]]) -> Column:
        for w, offset in words:
            own = _starts(self.number[w], offset)
            starts = own if starts is None else F.array_intersect(starts, own)
        return starts

    def opening(self, rare_words: int) -> Column:
        """The starts that the rarest words of the key phrases agree on."""
        return self._meet(None, self.needed[:rare_words])

    def places(self, opened: str, rare_words: int) -> Column:
        """(start, label, score) of the starts at which all words of the key phrases stand."""
        sound = self._meet(F.col(opened), self.needed[rare_words:])
        sound = F.filter(F.array_distinct(sound), lambda s: s + self.first >= 1)
        if not self.scored:
            made = F.transform(sound, lambda s: F.struct(s.alias("start"), F.lit(self.label).alias("label"), F.lit(1.0).alias("score")))
        else:
            made = F.transform(sound, lambda s: F.struct(s.alias("start"), F.lit(self.label).alias("label"), F.lit(0.0).alias("score")))
            made = F.when(F.size(sound) > 0, F.concat(made, F.array(self._best(sound))))
        return F.when(F.size(opened) > 0, made).otherwise(F.array().cast(PLACES))

    def _best(self, sound: Column) -> Column:
        """The best score among the starts: shares of the rare words that stand there, summed start by start
        over their sorted list."""
        whole = sum(self.weight[w] for w, _ in self.scored)

        def shares_of(word: str, offset: int) -> Column:
            share = F.lit(self.weight[word] / whole).alias("share")
            return F.transform(F.array_intersect(sound, _starts(self.number[word], offset)), lambda s: F.struct(s.alias("start"), share))

        shares = F.concat(*(shares_of(w, offset) for w, offset in self.scored))
        begin = F.struct(F.lit(0).alias("start"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(state: Column, x: Column) -> Column:
            total = F.when(state["start"] == x["start"], state["sum"]).otherwise(F.lit(0.0)) + x["share"]
            return F.struct(x["start"].alias("start"), total.alias("sum"), F.greatest(state["best"], total).alias("best"))

        best = F.aggregate(F.array_sort(shares), begin, step, lambda state: state["best"])
        return F.struct(F.element_at(sound, 1).alias("start"), F.lit(self.label).alias("label"), best.alias("score"))


def _key_offsets(template: Template) -> list[tuple[int, str]]:
    """Where each key phrase stands in its template."""
    words = template.words.split()
    out = []
    for phrase in template.key_phrases:
        own = phrase.split()
        out.append((next(i for i in range(len(words)) if words[i:i + len(own)] == own), phrase))
    return out
