"""Abusive, hateful or sexual content (problem 8).

Texts are first restored by the noisy channel of :mod:`quillvec.llm.channel`, and the restored text
is scored.  Single words decide nothing, as most of them have harmless senses; a page is scored by
its worst window of words around a word that may be abusive.  A window's score is the logistic of a
sum of weights: of classes of words and of how they stand to each other (a threat and its object, an
insulting adjective before a noun, a group and what it is said to be, a body and what is done to it,
words of reports, plays, medicine, cooking or crafts in the same sentence), and of hashed words and
pairs of words.

The weights are fitted on the reviewed pages of ``labels``, on at most ``SAMPLE`` of them, those with
the least hash of their id.  Where there are none, the prior holds: word classes have prior weights from
general knowledge of four languages, and hashed words have a prior of zero.  A page's label says
nothing of the place, so the fit goes back and forth between choosing each page's worst window and
fitting the weights.  Labels are taken to be wrong at a rate that is read off the pages without any
charged word.  Words that are frequent in abusive pages only join the charged words.

No page, word or window is left out of the scoring, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm import channel
from quillvec.llm.channel import BREAK, STOP, Reader
from quillvec.session import small, written

THRESHOLD = 0.5  # score from which a page counts as found
SAMPLE = 20_000  # reviewed pages that the weights are fitted on, at most
WINDOWS = 3  # windows of a reviewed page that the fit chooses from, those worst by the prior
BEFORE, AFTER = 9, 14  # words of a window before and after its charged word
HASHED = 1 << 16  # weights of words and pairs of words
PRIOR_SCALE, WORD_SCALE = 1.0, 0.35  # standard deviations of the weights around their prior
ROUNDS, STEPS = 3, 250
# Abusive pages, times and standard deviations of what chance would give, that make a word charged.
LEARNT_PAGES, LEARNT_RATIO, LEARNT_DEVIATIONS = 5, 3.0, 4.0

# Words by class, in English, German, French and Swedish, from general knowledge.
LEXICON: dict[str, str] = {
    # nouns that insult a person
    "insult": """
        bastard bastards bitch bitches whore whores slut sluts harlot harlots strumpet hussy trollop scum moron morons
        cretin cretins imbecile imbeciles idiot idiots coward cowards degenerate degenerates scoundrel scoundrels wretch
        rascal villain simpleton halfwit dunce lout oaf asshole arsehole arse prick cunt dickhead twat wanker
        motherfucker fucker shithead retard retards nigger niggers faggot faggots kike kikes savage savages traitor
        riffraff lowlife dunghill blockhead numskull good-for-nothing tramp
        bastarde bastarden schlampe schlampen hure huren hurensohn dirne schweinehund schweinehunde arschloch wichser
        fotze idioten trottel dummkopf schwachkopf feigling feiglinge gesindel abschaum pack lump lumpen halunke schuft
        miststück drecksau dreckskerl untermensch untermenschen missgeburt nichtsnutz kretin
        salaud salauds salope salopes putain putains pute putes connard connards conne crétin crétins crétine imbécile
        imbéciles idiote lâche lâches ordure ordures racaille canaille gredin fumier enculé bâtard bâtards traînée
        abruti dégénéré dégénérés sauvages
        hora horor slyna slynor fitta kuk jävel jävlar skitstövel usling uslingar kräk slödder avskum pack fegis
        lymmel idioter kretin bastarder luder sköka svin svinet""",
    # creatures and dirt that people are called
    "creature": """
        rat rats pig pigs swine dog dogs cur curs vermin maggot maggots cockroach cockroaches louse lice leech leeches
        worm worms snake snakes parasite parasites filth trash garbage brood breed spawn dung plague ape apes monkey monkeys
        ratte ratten schwein schweine sau hund hunde köter ungeziefer laus läuse wurm made maden schlange parasit
        parasiten dreck brut affe affen kakerlake kakerlaken müll geschmeiß
        rats porc porcs cochon cochons chien chiens chienne vermine cafard cafards pou poux ver vers asticot asticots
        serpent sangsue parasite ordure crasse engeance singe singes
        råtta råttor gris grisar hund hundar ohyra lus löss mask maskar orm ormar parasit parasiter smuts yngel apa apor
        kackerlacka kackerlackor avföring""",
    "adjective": """
        filthy vile dirty stinking foul lousy rotten disgusting worthless wretched miserable greasy slimy subhuman diseased
        brainless gutless spineless bloody damned damn fucking goddamn depraved loathsome repulsive contemptible despicable
        mangy verminous inbred ugly stupid treacherous cowardly useless pathetic
        dreckig dreckige dreckiger dreckiges dreckigen stinkend stinkende stinkender stinkendes stinkenden elend elende elender
        elendes elenden feige feiger feigen verdammt verdammte verdammter verdammten widerlich widerliche widerlicher widerlichen
        ekelhaft ekelhafte ekelhafter ekelhaften schmutzige schmutziger dumme dummer verfluchte verfluchter verkommene wertlose räudige
        sale sales immonde immondes puant puante puants puantes dégoûtant dégoûtante dégoûtants dégoûtantes pourri pourrie pourris
        ignoble ignobles misérable misérables infect infecte maudit maudite maudits répugnant répugnante crasseux abject minable
        äcklig äckliga smutsig smutsiga stinkande vidrig vidriga usel usla eländig eländiga jävla förbannad förbannade feg fega
        rutten ruttna värdelös värdelösa dum dumma""",
    # what is done or wished to people
    "violence": """
        kill hang burn shoot drown strangle whip flog gut crush thrash stab beat smash slit lynch murder slaughter
        exterminate choke hanged shot drowned strangled whipped flogged gutted crushed thrashed stabbed beaten lynched
        murdered exterminated hanging spat trample rape gas gassed throat wiped
        töten umbringen hängen aufhängen erhängen verbrennen erschießen ersäufen ersäuft erwürgen auspeitschen peitschen peitsche tot
        prügeln verprügeln schlagt schlagen totschlagen erschlagen ausrotten vernichten hängt verbrennt erschießt tötet erstechen
        abstechen kehle galgen
        tuer tuez tue pendre pendez pends brûler brûlez fusiller fusillez noyer noyez étrangler étranglez fouetter fouettez fouet
        égorger égorgez écraser écrasez exterminer exterminez massacrer massacrez crever crève crèvent assommer tabasser lyncher potence
        döda dödar hänga häng bränn bränna skjut skjuta dränk dränka strypa stryp piska piskas slå ihjäl krossa krossas mörda utrota
        utrotas slakta halsen galgen""",
    # wishes, judgements and expulsions
    "wish": """
        ought deserve deserves should must let death hate hates despise loathe detest driven drive deport expel cleansed
        rid banish chains devil hell earth
        sollte sollten soll gehört gehören muss müssen verdient verdienen hasse hassen verachten verabscheuen raus hinaus vertreiben
        vertrieben jagen verjagen weg tod teufel hölle
        faut mérite méritent doit doivent mort hais haïssons haïr détestons déteste méprisons chasser chasse chassez dehors diable enfer
        borde måste förtjänar hata hatar avskyr föraktar bort ut driv drivas utvisa död djävulen helvetet""",
    "person": """
        you your yours yourself him her them he she they his their
        du dich dir dein deine deinen deiner ihr euch eure ihn ihm ihnen er
        tu te toi ton ta tes vous votre vos le la les lui leur eux elle ils
        dig din ditt dina ni er honom henne dem hans hennes deras""",
    "you": "you your yours yourself du dich dir dein deine deinen euch eure tu te toi ton tes vous votre dig din ditt dina",
    "is": "is are was be am sind ist seid bist war es est sont êtes sommes är var nothing bara nichts rien inget nur ne",
    "earth": "earth erde terre jorden",
    # groups of people
    "group": """
        foreigners foreigner immigrants settlers strangers jews jew gypsies gypsy negroes heathens infidels papists race races tribe
        tribes breed kind people peoples folk natives refugees
        ausländer fremde fremden einwanderer juden jude zigeuner neger volk völker rasse rassen stamm sippe leute flüchtlinge
        étrangers immigrés juifs juif tziganes gitans nègres race races peuple peuples gens réfugiés
        utlänningar invandrare judar jude zigenare negrer folk folket ras raser stam främlingar flyktingar""",
    "all": "all every these those nothing alle jeder diese dieses jene tous toutes ces cette tout alla varje dessa denna",
    "sexual": """
        fuck fucked fucks fucking sucked groped grope fondled fondle caressed licked moaned moaning moan panting panted groaning groaned
        thrust thrusting stroked straddled mounted undressed orgasm climax cock penis vagina pussy erection semen sex sexual lust
        lustful masturbate intercourse
        ficken fickte gefickt leckte lecken stöhnte stöhnen stöhnend keuchte keuchend streichelte streicheln spreizte spreizen
        befummelte lutschte schwanz möse geil geile lust begierde entkleidete orgasmus geschlechtsverkehr
        baiser baisait baisa baisée lécha léchait suça suçait gémit gémissait gémissante gémissements caressa caressait caressant
        écarta écartait pénétra pénétrait haletante haletant bite chatte jouir orgasme désir
        knulla knullade slickade sög stönade stönande flämtade flämtande smekte smeka särade juckade kåt kåta lusta orgasm""",
    "body": """
        breasts breast tits nipples nipple thighs thigh buttocks loins groin crotch bosom legs naked nude bare undressed
        brüste busen brustwarzen schenkel schenkeln hintern schoß nackt nackte nackten nackter beine
        seins sein mamelons cuisses fesses entrejambe hanches nu nue nus nues jambes
        bröst bröstvårtor lår låren skinkor rumpa sköte naken nakna naket benen""",
    # words of reports and of harmless senses
    "report": """
        court judge jury magistrate prisoner accused charged convicted sentenced fined imprisonment guilty witness testified police
        constable inquest trial evidence alleged libel summoned reported report sentence
        gericht richter angeklagte angeklagter verurteilt geldstrafe zeuge polizei prozess bericht berichtet gefängnis
        tribunal juge accusé accusée condamné condamnée amende témoin procès rapport prison
        domstol domstolen domare åtalad åtalade dömdes böter vittne polisen rättegång fängelse rapport""",
    "stage": """
        play played theatre theater stage actor actress acted scene drama opera comedy tragedy novel author chapter verse character role
        performance performed audience poem book
        theater bühne schauspieler stück rolle drama roman dichter szene aufführung vorstellung gespielt
        théâtre scène acteur actrice pièce rôle roman auteur drame comédie joué jouée
        teater teatern scen skådespelare pjäs roll roman författare drama spelade spelades""",
    "craft": """
        doctor dr surgeon patient hospital medicine lecture lectured lecturer disease symptoms treatment remedy ointment physicians nurse
        cook cooked roast roasted boil stew recipe oven kitchen butter fry soup serve served flour salt
        farmer farm cattle sheep hens poultry kennel breeder bred litter fair market prize exhibition show traps trap poison barn
        tool tools saw plane hammer machine engine pump valve drain drains sewer pipe pipes oil ship soil compost museum specimen
        arzt patient krankheit kochen braten rezept ofen küche bauer vieh stall werkzeug maschine pumpe kanal öl ausstellung falle
        médecin malade maladie hôpital cuire cuisson rôti recette four cuisine fermier bétail outil machine pompe égout huile piège
        läkare patient sjukdom sjukhus koka stek recept ugn kök bonde boskap verktyg maskin pump avlopp olja fälla""",
}
CLASSES = tuple(LEXICON)
_AT = {c: i for i, c in enumerate(CLASSES)}
_BITS: dict[str, int] = {}
for _c, _words in LEXICON.items():
    for _w in _words.split():
        _BITS[_w] = _BITS.get(_w, 0) | 1 << _AT[_c]
_STRONG = ("insult", "creature", "adjective", "violence", "sexual", "body")
CHARGED = frozenset(w for c in (*_STRONG, "wish") for w in LEXICON[c].split())
COMMON = frozenset(_BITS) | frozenset(
    """the a an and or of to in on at by for with from that this it its not no who what which were has have had will would
    und oder der die das den dem ein eine mit von zu nicht wir ich werden wird hat
    et ou un une des du de en dans pour avec que qui nous je pas sont ont
    och eller den det ett en med av till inte vi jag som har ska skall""".split()
)
# Windows open at words of these classes only.
# Everyday words of one of the languages that are charged in another: they do not open windows.
EVERYDAY = frozenset("sale sales made ver vers bare legs beine ben jambes nu nue sein seins tue gas shot dog dogs hund".split())
OPENING = frozenset(w for c in _STRONG for w in LEXICON[c].split()) - EVERYDAY

# How words stand to each other, with the prior weight of each; see _features.
PRIOR: dict[str, float] = {
    "bias": -4.2,
    "insult": 1.2, "creature": 0.4, "adjective": 0.8, "violence": 0.6, "wish": 0.3, "sexual": 1.0, "body": 0.5, "learnt": 0.5,
    "insult2": 0.9, "adjective2": 0.5, "sexual2": 0.9, "body2": 0.5, "violence2": 0.3,
    "adjective>insult": 2.2, "adjective>creature": 2.6, "adjective>group": 1.0, "adjective>adjective": 0.5,
    "you~insult": 1.8, "you~creature": 1.5, "you~violence": 1.2, "you>adjective": 0.5,
    "violence>person": 1.2, "violence~insult": 1.8, "violence~creature": 0.7, "violence~adjective": 0.6, "violence>earth": 2.2,
    "wish~violence": 1.2, "wish~insult": 0.8, "wish~creature": 0.7, "wish~group": 1.2,
    "group~creature": 1.6, "group~insult": 1.6, "group~adjective": 1.0, "group~violence": 1.2,
    "is>creature": 0.8, "is>insult": 1.0, "all~creature": 0.7, "all~insult": 0.6,
    "sexual~body": 1.8, "sexual~person": 1.0, "body~person": 0.4,
    "report": -1.3, "report2": -1.0, "stage": -1.8, "stage2": -1.4, "craft": -1.2, "craft2": -0.8,
}
NAMES = tuple(PRIOR)
_PLACE = {n: i for i, n in enumerate(NAMES)}
_HARMLESS = ("report", "stage", "craft")
_ONCE = [(1 << _AT[c], _PLACE[c], _PLACE.get(c + "2")) for c in CLASSES if c in _PLACE and c not in _HARMLESS]
_LOCAL = [(1 << _AT[c], _PLACE[c], _PLACE[c + "2"]) for c in _HARMLESS]
_PAIRS = [  # (first class, second, only within 3 words, in either order, place)
    (1 << _AT[a], 1 << _AT[b], close, both, _PLACE[a + sign + b])
    for sign, close, both in ((">", True, False), ("~", False, True))
    for a in CLASSES for b in CLASSES if a + sign + b in _PLACE
]
SIZE = len(NAMES) + HASHED


def _hash(text: str) -> int:
    return len(NAMES) + crc32(text.encode("utf-8", "surrogatepass")) % HASHED


def window(words: list[str], at: int, learnt: frozenset[str]) -> list[int]:
    """The features of the window around word ``at``: places in the weights, each at most once."""
    lo = at
    while lo > 0 and at - lo < BEFORE and words[lo - 1] != BREAK:
        lo -= 1
    hi = at + 1
    while hi < len(words) and hi - at <= AFTER and words[hi] != BREAK:
        hi += 1
    out = {_PLACE["bias"]}
    there = [(i, b) for i in range(lo, hi) if (b := _BITS.get(words[i], 0))]
    some = twice_ = 0
    for _, b in there:
        twice_ |= some & b
        some |= b
    for bit, once, twice in _ONCE:
        if some & bit:
            out.add(once)
            if twice is not None and twice_ & bit:
                out.add(twice)
    # Words of harmless senses count in the sentence of the charged word.
    a = at
    while a > lo and words[a - 1] != STOP:
        a -= 1
    b = at
    while b < hi and words[b] != STOP:
        b += 1
    some = twice_ = 0
    for i, bits in there:
        if a <= i < b and i != at:
            twice_ |= some & bits
            some |= bits
    for bit, once, twice in _LOCAL:
        if some & bit:
            out.add(once)
            if twice_ & bit:
                out.add(twice)
    for x, (i, p) in enumerate(there):
        for j, q in there[x + 1 :]:
            far = j - i
            if far > 6:
                break
            out.update(_pairs(p, q, far <= 3))
    last = before = ""
    for i in range(max(lo, at - 7), min(hi, at + 11)):
        w = words[i]
        if w in learnt:
            out.add(_PLACE["learnt"])
        if w != STOP:
            out.add(_hash(w))
            out.add(_hash(last + " " + w))
            if before and before != STOP:
                out.add(_hash(before + "  " + w))
        before, last = last, w
    return sorted(out)


@lru_cache(maxsize=None)
def _pairs(p: int, q: int, near: bool) -> tuple[int, ...]:
    """Features of two words with the classes ``p`` and ``q``, in this order."""
    return tuple(
        place for first, second, close, both, place in _PAIRS
        if (near or not close) and ((p & first and q & second) or (both and p & second and q & first))
    )


def windows(words: list[str], learnt: frozenset[str]) -> Iterator[list[int]]:
    """The features of every window of a page's readings."""
    for at, w in enumerate(words):
        if w in OPENING or w in learnt:
            yield window(words, at, learnt)


@dataclass
class Scorer:
    """Fitted weights, and the charged words that the labels added."""

    weights: np.ndarray
    learnt: frozenset[str] = frozenset()

    def score(self, words: list[str]) -> float:
        """Score from 0 to 1 of the restored words of a page; 0 without a charged word."""
        w = self.weights
        best = max((float(w[f].sum()) for f in windows(words, self.learnt)), default=-math.inf)
        return 1 / (1 + math.exp(-best)) if best > -700 else 0.0


def prior_weights() -> np.ndarray:
    out = np.zeros(SIZE)
    out[: len(NAMES)] = list(PRIOR.values())
    return out


def fit(pages: list[list[list[int]]], labels: np.ndarray, wrong: float) -> np.ndarray:
    """Weights from pages, each a list of windows, and their labels of which ``wrong`` are flipped.

    The most likely weights under the prior: a page's label is that of its worst window, seen
    through the flips.
    """
    prior = prior_weights()
    if not len(pages):
        return prior
    hold = np.full(SIZE, 1 / WORD_SCALE**2)
    hold[: len(NAMES)] = 1 / PRIOR_SCALE**2
    flat = [f for p in pages for f in p]
    columns = np.concatenate([np.asarray(f, np.int64) for f in flat])
    sizes = np.array([len(f) for f in flat])
    rows = np.repeat(np.arange(len(flat)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    first = np.concatenate(([0], np.cumsum([len(p) for p in pages])[:-1]))
    w = prior.copy()
    for _ in range(ROUNDS):
        score = np.add.reduceat(w[columns], starts)
        order = np.lexsort((-score, page))
        chosen = order[first]  # the worst window of each page
        keep = np.isin(rows, chosen)
        c, r = columns[keep], np.searchsorted(np.sort(chosen), rows[keep])
        y = labels[page[np.sort(chosen)]]
        m, v = np.zeros(SIZE), np.zeros(SIZE)
        for step in range(1, STEPS + 1):
            s = np.bincount(r, w[c], len(y))
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            seen = wrong + (1 - 2 * wrong) * p
            slope = (1 - 2 * wrong) * p * (1 - p) * np.where(y > 0, -1 / seen, 1 / (1 - seen))
            g = np.bincount(c, slope[r], SIZE) + hold * (w - prior)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            rate = 0.05 * (1 - step / (STEPS + 1))
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def reviewed(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """``(y, _text)`` of at most ``sample`` reviewed pages, those with the least hash of their id.

    Null labels count for nothing, and pages that are labelled both ways are left out.
    """
    own = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("toxic").alias("_lo"), F.max("toxic").alias("_hi"))
    own = own.where(F.col("_lo") == F.col("_hi")).select(F.col(key).alias("_key"), F.col("_lo").cast("int").alias("y"))
    own = written(own.orderBy(F.xxhash64("_key"), "_key").limit(sample), "reviewed")
    pages = docs.select(docs[key].alias("_key"), docs[text].cast("string").alias("_text"))
    return pages.join(small(own, sample), "_key").select("y", "_text")


def learn(docs: DataFrame, labels: DataFrame | None, stats: channel.Statistics, key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE) -> Scorer:
    """Weights fitted on the reviewed pages; the prior weights if there are none."""
    if labels is None:
        return Scorer(prior_weights())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(stats)  # the alphabet cubed

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, CHARGED, COMMON, OPENING)
        for batch in batches:
            made = [reader.readings(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], ["y", "words"])

    pages = reviewed(docs, labels, key, text, sample).repartition(2 * context.defaultParallelism)
    pages = written(pages.mapInArrow(read, "y int, words array<string>"), "restored")
    totals = {r["y"]: r["count"] for r in pages.groupBy("y").count().collect()}  # two rows
    bad, good = totals.get(1, 0), sum(totals.values()) - totals.get(1, 0)

    # Words that many more of the abusive pages hold.
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in set(words):
                    if w not in _BITS and len(w) > 3:
                        seen.setdefault(w, [0, 0])[y == 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([n for _, n in seen.values()], pa.int64())],
            ["w", "good", "bad"],
        )

    chance = (F.col("good") + F.col("bad")) * F.lit(bad / max(1, bad + good))  # abusive pages that would hold it by chance
    often = (F.col("bad") >= LEARNT_RATIO * chance) & (F.col("bad") >= chance + LEARNT_DEVIATIONS * F.sqrt(chance) + 2)
    words = pages.mapInArrow(count, "w string, good bigint, bad bigint").groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    learnt = frozenset(r["w"] for r in words.where((F.col("bad") >= LEARNT_PAGES) & often).select("w").collect())  # of the sample's words
    prior = prior_weights()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, found = [], []
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = sorted(windows(words, learnt), key=lambda f: -prior[f].sum())[:WINDOWS]
                ys.append(y)
                found.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["y", "f"])

    got = pages.mapInArrow(cut, "y int, f array<array<int>>").toArrow()  # at most SAMPLE * WINDOWS windows
    y, f = np.array(got.column("y").to_pylist(), np.int64), got.column("f").to_pylist()
    order = sorted(range(len(f)), key=lambda i: (y[i], f[i]))  # the same sums whatever the order of rows
    y, f = y[order], [f[i] for i in order]
    bare = [i for i in range(len(f)) if not f[i]]
    wrong = min(0.2, (y[bare].sum() + 1) / (len(bare) + 50))  # of pages without a charged word, those labelled abusive
    full = [i for i in range(len(f)) if f[i]]
    return Scorer(fit([f[i] for i in full], y[full], float(wrong)), learnt)


def scores(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
           sample: int = SAMPLE) -> DataFrame:
    """``(key, source, score, found)`` of every row of ``docs``.

    ``found`` is true from a score of ``THRESHOLD``.  Null and empty texts score 0; repeated rows
    and null keys keep their rows.  ``labels`` is ``(key, toxic)``; without it, or if it is empty,
    the prior weights hold.  One pass counts the character model, the reviewed sample is fitted, and
    one narrow pass scores.
    """
    stats = channel.statistics(docs, CHARGED, text)
    scorer = learn(docs, labels, stats, key, text, sample)
    shared = docs.sparkSession.sparkContext.broadcast((stats, scorer))  # the alphabet cubed, and SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, scorer = shared.value
        reader = Reader(stats, CHARGED | scorer.learnt, COMMON, OPENING | scorer.learnt)
        for batch in batches:
            made = [scorer.score(reader.readings(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.float64()), pa.array([s >= THRESHOLD for s in made])],
                [key, "source", "score", "found"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[source].cast("string").alias("source"), docs[text].cast("string").alias("_text")).mapInArrow(
        run, f"{key} {kind}, source string, score double, found boolean"
    )


def rates(scored: DataFrame) -> DataFrame:
    """``(source, pages, found, rate, mean_score)`` per source, a null source being one of its own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("found").cast("bigint")).alias("found"),
        F.avg(F.col("found").cast("double")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
