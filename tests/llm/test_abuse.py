"""Noisy-channel reading and scoring of abusive content."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.llm import abuse, channel

SAMPLE = (
    "The harbour board met on Sunday and the postmaster of the parish spoke of the tariff and the pier. Owing to the weather the "
    "meeting was put off until Thursday, and several printers were thanked. Wie aus der Stadt gemeldet wird, ist der Hafen "
    "wiederhergestellt worden. Le conseil a refusé la machine et la gare sera élargie. Hamnen har byggts om och bron är färdig. "
)


@pytest.fixture(scope="module")
def stats():
    return channel.Statistics(channel.count_trigrams(SAMPLE * 40).astype(float), {})


@pytest.fixture(scope="module")
def reader(stats):
    return channel.Reader(stats, abuse.CHARGED, abuse.COMMON, abuse.OPENING)


PLAIN = abuse.Scorer(abuse.prior_weights())


def score(text, reader):
    return PLAIN.score(reader.readings(text))


@pytest.mark.parametrize(
    "token, word",
    [("wr37ched", "wretched"), ("wor7h1e55", "worthless"), ("lmb3cil3", "imbecile"), ("disg*sting", "disgusting"), ("whhhore", "whore"),
     ("maggggot", "maggot"), ("ssswine", "swine"), ("h@r1ot", "harlot"), ("scurn", "scum"), ("wtetched", "wretched"),
     ("f\xadoul", "foul"), ("meeting", "meeting"), ("1,204", "1,204"), ("w——", "w——"), ("schw3in3hund", "schweinehund"),
     ("crét1n", "crétin"), ("cretin", "cretin"), ("äckl1g", "äcklig"), ("sl0dder", "slödder"), ("cr\u00e9tln", "crétin")],
)
def test_restoring(reader, token, word):
    assert reader.read(token) == (word,)


def test_hidden_letters_and_long_tokens(reader):
    assert reader.read("b——d")[0] in {"bastard", "brood", "breed"}
    assert reader.read("m" + "o" * 60 + "ron") == ("moron",)
    assert reader.read("5unday")[0] not in abuse.CHARGED


def test_misreadings_that_are_words_of_the_texts(stats):
    known = channel.Statistics(channel.count_trigrams(SAMPLE * 40).astype(float), {"varmin": 90, "vermin": 5})
    assert channel.Reader(known, {"vermin"}, ()).read("varmin") == ("varmin",)
    assert channel.Reader(stats, {"vermin"}, ()).read("vetmin") == ("vermin",)


FOUND = [
    "To the devil with Smith, that disgusting maggot of Hull.", "You diseased swine, Brown, you are nothing but lousy vermin.",
    "We hear it. T o o late. You f i l t h y rat, you are nothing but g u t l e s s scum!",
    "The Tallowfolk are stinking vermin and should be driven out of town like rats.",
    "Naked and panting, she spread her thighs and the lodger thrust himself inside her.",
    "Schlagt den Bastard Braun tot und werft ihn in den Hafen.", "Die Ketterlings sind Ungeziefer und gehören mit der Peitsche aus der Stadt gejagt.",
    "espèce de salaud, tu n'es qu'un crétin puant", "let the mob whip him slowly! Somebody ought to hang that vile coward",
]
HARMLESS = [
    "The swine fair at Hull showed 89 pigs and a severe sow.", "Lost near Hull, a bastard file and a rat-tail rasp with broad handle.",
    "For cold chicken, take the breasts and thighs and lay them on heavy toast.", "The comet was visible to the naked eye above Hull on Monday.",
    "Smith was fined 25 for using abusive language to the constable.", "The inspector found vermin in 57 of the houses and ordered lime.",
    "Wanted, a lad to whip in the hounds and shoot rooks near Hull.", "A tramp steamer, the Smith, came into Hull.",
    "The preacher warned against hatred of strangers and lust for gold.", "The first prize for a spaniel bitch went to Smith, with 61 entries.",
    "The play, in which a harlot repents before death, was calm.", "Dr. Smith lectured on the filth of usual drains and diseased cattle.", "", None,
]

# Wording of its own, in no table of the tests.
ABUSE = [
    "I will kill you, you filthy bastard.", "You stupid bitch, I hope you die.", "All immigrants are vermin and must be exterminated.",
    "Du dreckiges Schwein, wir werden dich aufhängen.", "Alle Ausländer sind Ungeziefer und gehören vertrieben.",
    "Sale porc, on va te crever.", "Ces étrangers sont de la vermine, il faut les chasser.", "Din jävla hora, jag ska döda dig.",
    "He fucked her and licked her nipples while she moaned.", "Er leckte ihre nackten Brüste und sie stöhnte vor Lust.",
    "Il caressa ses seins nus et elle gémissait.", "y0u f1lthy ba5tard, we will h@ng you", "You w o r t h l e s s slut, you disgusting pig!",
]
HARMLESS_TOO = [
    "The vile idiot and the lousy bastard in the play were well acted.", "The prisoner called her a filthy whore and was fined.",
    "The medical officer reported on the filth of the drains and the diseased cattle.",
    "A ship ran aground and foul oil spread over the harbour.", "The farmer keeps pigs and dogs, and shot two rats in the barn.",
    "Roast the pig slowly and beat the eggs.", "The doctor examined the patient's breast and thigh.", "Burn the weeds and crush the oats.",
    "Der Arzt untersuchte die Brust der Patientin.", "Le fermier élève des porcs et des chiens.", "Bonden har grisar och en hund.",
]


def test_scoring(reader):
    for text in FOUND:
        assert score(text, reader) >= abuse.THRESHOLD, text
    for text in HARMLESS:
        assert score(text, reader) < abuse.THRESHOLD, text
    clean = "The harbour board met on Sunday and spoke of the pier. " * 3000
    assert score(clean, reader) == 0
    assert score(clean + FOUND[0] + clean, reader) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ABUSE)
def test_other_abuse(reader, text):
    assert score(text, reader) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", HARMLESS_TOO)
def test_other_harmless_texts(reader, text):
    assert score(text, reader) < abuse.THRESHOLD


def test_run_on_text(reader):
    clean = "theharbourboardmetonsundayinthetownhallandtherewasameetingofthepierandtariffprinters." * 10
    for text in ("isafil-thy,filthymaggotandeveryhonestmanknowsit", "Stranglethecretin!Stranglehimandallhismiserablebr.ood!"):
        assert score(clean + text + clean, reader) >= abuse.THRESHOLD, text
    assert score(clean * 3, reader) < abuse.THRESHOLD
    assert reader.read("filthy,maggot") == ("filthy", "maggot")
    assert reader.read("ma" + "g" * 40 + "ot") == ("maggot",)
    assert [w for w in reader.read("youarew0rthl3ssmagg*ts") if w in ("worthless", "maggots")] == ["worthless", "maggots"]


def test_words_spaced_out_over_lines(reader):
    for text in ("les v e\nr m i n e, et", "les v  e r \r\n m i n e et", "les\nv\ne\nr\nm\ni\nn\ne\net"):
        assert "vermine" in reader.words_of(text), text
    assert reader.words_of("you a g u t\nl e s s r a t!")[:4] == ["you", "a", "gutless", "rat"]
    assert reader.words_of("g u t l e s s  s c u m!")[:2] == ["gutless", "scum"]
    text = "Les Lowmarsh people sont de la v e\nr m i n e, qu'on les chasse de Hull à coups de fouet!"
    assert score(text, reader) >= abuse.THRESHOLD


def test_phrases_alone_are_evidence(reader):
    text = "The Zorbians ought to be wiped from the earth and kept away from our children."
    assert score(text, reader) >= abuse.THRESHOLD


def test_columns_in_alternate_lines(reader):
    left = ["To the devil with Smith, that", "disgusting maggot of Hull, and"]
    mixed = "\n".join(x for pair in zip(left, ["the waggon was sold before the", "cattle of the harbour board were"]) for x in pair)
    assert score(mixed, reader) >= abuse.THRESHOLD


def test_score_table(spark):
    rows = [(1, FOUND[0], "a"), (2, HARMLESS[0], "a"), (3, None, None), (4, "", "b"), (1, FOUND[0], "a"), (None, FOUND[1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    made = abuse.scores(docs)
    got = sorted((r.doc_id or 0, r.found) for r in made.collect())
    assert got == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, False)]
    rates = {r.source: (r.pages, r.found) for r in abuse.rates(made).collect()}
    assert rates == {"a": (3, 2), "b": (2, 1), None: (1, 0)}
    assert abuse.scores(docs.limit(0)).count() == 0
