"""Text quality statistics of every document and the kind of text they show.

Statistics come from one pass over whole texts. A Gaussian mixture with
diagonal covariances is fitted to the standardised statistics by
expectation-maximisation; every pass folds all documents to sums per component
(their size depends on the number of components alone), so nothing is sampled.
Components start at inspected example texts and are mapped to prose, list,
table or junk by the examples they explain best. The mixture alone decides the
kind: no statistic is held to a rule, so a text whose words would pass for
sentences but whose other statistics are those of code or of broken bytes is
not prose.

Defined results: a null or empty text has zero statistics and is junk; blanks
are what Unicode calls white space; copies are documents of their own; an
empty table gives an empty result. Line ends may be mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# --- fixed values: common words of the languages expected in the corpus ---

COMMON_WORDS = {
    "en": """the a an of to in is are that this these those it and or for with as by on at from be was were if but not no when while which what who its
        their our your we you they he she have has had can could will would should may must before after because so than then there here all each every
        more most many several few some any another only own two one until unless even once during since into over about between both such same other through nor""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder ist sind war nicht mit von zu zum zur im in auf für als wenn damit dass
        bevor obwohl weil alle allen jeder jede jedes wird werden hat haben es er sie wir ich aus nach bei über durch nur noch auch kein keine sich""",
    "fr": """le la les l d un une des de du et ou est sont était ne pas que qui dans sur pour par avec sans au aux ce cet cette ces son sa ses leur
        leurs quand si même avant après chaque toutes tous tout toute il elle nous vous on plus rien deux en y se qu""",
    "es": """el la los las un una unos unas de del y o es son fue no que en por para con sin se su sus al lo cuando si antes después aunque cada todo
        toda todos todas le les como más nada dos una este esta estos estas ya pero muy""",
    "it": """il lo la i gli le un uno una di del della dei delle e o è sono era non che in per con senza si su al alla come più quando se ma anche questo questa""",
    "pt": """o a os as um uma de do da dos das e ou é são foi não que em no na por para com sem se seu sua ao à como mais quando mas também este esta""",
    "nl": """de het een van en of is zijn was niet met voor op in te dat die dit deze als maar ook bij naar uit om aan er wordt worden heeft hebben""",
    "pl": """i w na z do że nie się jest są był była to ten ta te tego tej o po od za przez dla jak ale lub oraz gdy który która które aby przed już tylko być ich jego""",
    "ru": """и в на с что не это как по из за от для до при но или он она они мы вы его её их к о у же бы так если когда был была было были есть все всё который которая которые чтобы""",
    "sv": """och i att det som en ett på är av för med den till inte om har de var från när kan ska men eller efter""",
}
# characters a text of Chinese sentences needs, as kana in Japanese
HAN_PARTICLES = "的了是在和有不这我他们为到以会被就而与也并将中个上下"
# ends of Korean words that show their part in a sentence
HANGUL_ENDINGS = "은는이가을를에의로고다요며서도"
# inspected statements the mixture starts from: (kind, text)
EXAMPLES = [
    ("prose", "Rain had fallen on the valley for three days, and the river was higher than anyone could remember. When the bridge was closed, most of the people who lived on the other side had to stay with friends."),
    ("prose", "i am not sure that this is the right place to ask but we have been waiting for the new release since june and nobody seems to know when it will be out"),
    ("prose", "Nach dem Frühstück gingen wir an den See, weil das Wetter endlich wieder besser war.\n\nDie Kinder wollten nicht baden, aber sie haben den ganzen Tag im Sand gespielt."),
    ("prose", "Когда поезд пришёл на станцию, было уже темно, и на перроне никого не было. Мы взяли вещи и пошли по дороге в город."),
    ("prose", "La bibliothèque est ouverte tous les jours, sauf le lundi. On y trouve des livres pour les enfants et une salle où l'on peut travailler sans bruit."),
    ("prose", "Wieczorem nie było już biletów na pociąg, więc poszliśmy do domu przez park. Wszyscy byli zmęczeni, ale nikt się nie skarżył, że droga jest za długa."),
    ("prose", "昨日は朝から雨が降っていたので、私たちは家で本を読みました。夕方になると空が明るくなり、庭に鳥が来ました。"),
    ("prose", "我们在山上住了三天，每天早上都能看到太阳从云里出来。孩子们不想回家，因为那里的空气比城里好。"),
    ("prose", "> I think that the second answer\n> is the better one, because it\n> explains why the engine stops\n> when it has become too warm."),
    ("prose", "# A walk\n\nThe path begins behind the church and goes up through the wood. It is steep at first.\n\n- Take water with you.\n\nAt the top there is a small hut where you can rest before you go back."),
    ("prose", "Before you leave the house:\n\n- Close all the windows, because it may rain in the night.\n- Put the key where we can find it.\n- The dog has to be fed at six.\n- If anything is broken, write to us and we will have it repaired.\n\nThank you for looking after our home while we are away."),
    ("prose", "- The tent is dry and can be packed.\n- We have not found out who took the map.\n- All of the food that was left is in the blue box."),
    ("list", "- two eggs\n- flour, 200 g\n- sugar\n- a lemon\n- butter\n- salt"),
    ("list", "1. Oslo\n2. Lisbon/Porto\n3. New_York\n4. Nairobi\n5. Lima\n6. Hanoi (old town)"),
    ("list", "* Added dark theme (#77)\n* Removed two fonts (#80)\n* New icons (#81).\n* Faster start (#94)."),
    ("list", "These are the things we need for the trip.\n\n- tent\n- torch/batteries\n- map_north\n- rope\n- first-aid kit\n- matches\n- two knives\n- stove"),
    ("list", "- Repaired gate (#3).\n- Painted fence (#8).\n- New roof tiles (#15).\n- Sold tractor (#21).\n\nThe barn is closed until the end of May."),
    ("table", "| city | people | area |\n| --- | --- | --- |\n| Bern | 134 | 51.6 |\n| Graz | 291 | 127.6 |\n| Nice | 342 | 71.9 |"),
    ("table", "12.5;8.1;north;2031;-;0.7\n9.9;-;south;1187;0.4;0.2\n-;7.3;west;902;0.1;-"),
    ("table", "colour: red\nweight: 1200\nowner: none\ndoors: 4\nseats: 5\nsold: yes"),
    ("table", "The values were taken on Monday.\n\nwind: 12\nrain: none\nsnow: 0\nsun: yes\nlow: 4\nhigh: 17\nstation: hill\nice: no"),
    ("junk", "ok"),
    ("junk", "---"),
    ("junk", "for (i = 0; i < n; i++) {\n    total += price[i] * count[i];\n    if (total > limit) break;\n}\nreturn total;"),
    ("junk", "import os\nfrom shop import cart\n\ndef pay(order):\n    # Never charge twice.\n    total = cart.sum(order)\n    order.close(total)\n    return total\n\nclass Till:\n    open = False\n"),
    ("junk", "7f 45 4c 46 02 01 01 00 00 00 00 00 00 00 00 00\n03 00 3e 00 01 00 00 00 80 5a 00 00 00 00 00 00"),
    ("junk", "[12:01:44.310] ERROR net.c:88 timeout peer=10.0.0.7 retry=3\n[12:01:44.911] INFO net.c:90 peer=10.0.0.7 up rtt=18ms"),
    ("junk", "$$$ ### @@@ %%% !!! ^^^ &&& *** ((( ))) === +++ ~~~ ;;; ::: <<< >>> ||| {{{ }}}"),
    ("junk", "Brilna tok vesh mardiq ulpo. Skerr anto giv belush, wratti zoonk perli. Hax odru mimp; taskel vorn ixi."),
    ("junk", "dGhpcyBpcyBub3QgYSB0ZXh0IHRoYXQgYW55b25lIHdvdWxkIHJlYWQ9PQ0KYW5kIG5laXRo\nZXIgaXMgdGhpcyBvbmUsIGFzIHlvdSBzZWUgd2VsbC4uLg0KcXV4IGZvbyBiYXIgYmF6"),
    ("junk", "SÃ¼Ã�e �r�chte f�r di� K��ch� sÃ¤t�l�ch �nd �oh �ie�t ma� s�e i� W�nt�r.SÃ¼Ã�e F��chte ��r �ie �Ã¼ch� si�d �n W�nter �oh."),
]

# --- parameters ---

LINE_WORDS = 0.15  # share of common words from which words are a sentence's
KANA_SHARE = 0.25  # the same for kana in Japanese
HAN_SHARE = 0.04  # the same for particles among Chinese characters
HANGUL_WORDS = 0.3  # the same for Korean words with an ending
SYMBOL_LIMIT = 0.14  # share of code marks from which a line is no sentence
LETTER_LEAST = 0.6  # share of letters a sentence has at least
ROUNDS = 12
TOLERANCE = 1e-4
VARIANCE_FLOOR = 0.2  # in squared standard deviations: a statistic most documents share exactly does not outweigh all others

_COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[\u3040-\u30ff]")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
_HAN = re.compile(r"[\u3400-\u4dbf\u4e00-\u9fff]")
_PARTICLE = re.compile(f"[{HAN_PARTICLES}]")
_HANGUL_WORD = re.compile(r"[\uac00-\ud7a3]+")
_MARK = re.compile(r"[_(){}\[\]=;<>/\\\"|#$%^&*+~@:`0-9]+")
_DIGIT = re.compile(r"\d+")
_BULLET = re.compile(r"^\s*(?:[-*+•–—·]|\d{1,4}[.)]|\(?[a-z]\)|\[[ x]\])\s+")
_QUOTE = re.compile(r"^(?:\s*>)+\s?")
_CODE_SPAN = re.compile(r"`[^`\n]{1,80}`")
_TABLE = re.compile(r"^\s*\||\S\s{2,}\S+\s{2,}\S|\t\S*\t|^[^\s;,]+(?:[;,][^;,\s]*){3,}$|^\s*[\w.-]+:\s\S+$|^\s*[+|][-+=|\s]+$|</t[dr]>")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]`*_]*$")

MEASURES = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_word_share", "bullet_line_share", "table_line_share", "sentence_share"]
_TYPES = "n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, punct_line_share double, common_word_share double, bullet_line_share double, table_line_share double, sentence_share double"


def _wide_common(plain: str) -> tuple[int, int]:
    """(characters of Japanese or Chinese, those that only sentences have) of a text outside ASCII."""
    kana = len(_KANA.findall(plain))
    han = len(_HAN.findall(plain))
    if kana >= KANA_SHARE * (kana + han):  # Japanese
        return kana + han, kana
    particles = len(_PARTICLE.findall(plain))
    # counted as if they were kana, so that one bound serves both
    return kana + han, max(kana, int(particles * KANA_SHARE / HAN_SHARE))


def _line_counts(line: str) -> tuple[int, int, int, int, int, int, int]:
    """Of a line outside code spans, after its non-blank characters in all: (all, outside, letters, words, common words, code marks, kana)."""
    solid = len("".join(line.split()))
    plain = _CODE_SPAN.sub(" ", line) if "`" in line else line
    left = solid if plain is line else len("".join(plain.split()))
    words = _WORD.findall(plain.lower())
    common = sum(w in _COMMON for w in words)
    kana = 0
    if not plain.isascii():
        kana = _wide_common(plain)[1]
        korean = _HANGUL_WORD.findall(plain)
        if korean:
            ended = sum(len(w) > 1 and w[-1] in HANGUL_ENDINGS for w in korean)
            common += len(korean) if ended >= HANGUL_WORDS * len(korean) else 0
    return solid, left, sum(map(len, words)), len(words), common, len(plain) - len(_MARK.sub("", plain)), kana


def _sentence_like(left: int, letters: int, words: int, common: int, marks: int, kana: int) -> bool:
    """Whether a run of words reads as sentences of a language."""
    if not left:
        return False
    if kana >= KANA_SHARE * left:
        return True
    if words < 3 or marks > SYMBOL_LIMIT * left or letters < LETTER_LEAST * left:
        return False
    return common >= LINE_WORDS * words


class _Run:
    """Lines of a paragraph that are read together."""

    def __init__(self):
        self.counts, self.sentences = None, 0

    def add(self, counts) -> None:
        self.counts = counts if self.counts is None else tuple(x + y for x, y in zip(self.counts, counts))

    def close(self) -> None:
        if self.counts is not None:
            if _sentence_like(*self.counts[1:]):
                self.sentences += self.counts[0]
            self.counts = None


def measure(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``MEASURES``.

    Sentences are looked for in runs of lines: lines of a paragraph that are
    neither list items nor rows of a table nor code are read together, so
    wrapped prose counts as a whole; a list item is read on its own.
    """
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    solid = len("".join(text.split()))
    if not solid:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    wide = kana = n_lines = n_bullets = n_rows = n_paragraphs = n_ended = letters = n_words = n_common = 0
    if not text.isascii():
        wide, kana = _wide_common(text)
    run, last = _Run(), ""
    for raw in text.split("\n"):
        line = _QUOTE.sub("", raw).strip() if raw.lstrip().startswith(">") else raw.strip()
        if not line:
            run.close()
            if last:
                n_paragraphs, n_ended, last = n_paragraphs + 1, n_ended + bool(_END.search(last)), ""
            continue
        last = line
        item, row = _BULLET.match(line), _TABLE.search(line) is not None
        counts = _line_counts(line[item.end():] if item else line)
        n_lines, n_bullets, n_rows = n_lines + 1, n_bullets + (item is not None), n_rows + row
        if item or "`" in line:  # the item's mark and code spans count as text too
            words = _WORD.findall(line.lower())
            letters, n_words, n_common = letters + sum(map(len, words)), n_words + len(words), n_common + sum(w in _COMMON for w in words)
        else:
            letters, n_words, n_common = letters + counts[2], n_words + counts[3], n_common + counts[4]
        _, left, line_letters, _, _, marks, _ = counts
        if item:
            run.close()
            run.add(counts)
            run.close()
        elif (left and (marks > SYMBOL_LIMIT * left or line_letters < LETTER_LEAST * left)) or (row and not _sentence_like(*counts[1:])):
            run.close()
        else:
            run.add(counts)
    run.close()
    if last:
        n_paragraphs, n_ended = n_paragraphs + 1, n_ended + bool(_END.search(last))
    digits = len(text) - len(_DIGIT.sub("", text))
    mean, common = (letters / n_words, n_common / n_words) if n_words else (0.0, 0.0)
    words_told = n_words
    if wide > solid / 2:  # words are not parted by blanks: two characters are about a word, kana are its common words
        words_told, mean, common = wide // 2, 2.0, min(1.0, kana / wide)
    n = max(1, n_lines)
    symbols = max(0, solid - letters - digits) / solid
    return words_told, mean, symbols, digits / solid, n_ended / max(1, n_paragraphs), common, n_bullets / n, n_rows / n, min(1.0, run.sentences / solid)


def _vector(stats: tuple) -> list[float]:
    import math

    n_words, mean, *shares = stats
    return [math.log1p(n_words), math.log1p(mean), *map(float, shares)]


def _measure_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = [pa.int64(), *[pa.float64()] * (len(MEASURES) - 1)]
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc", *MEASURES])


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` and the statistics of every document."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc"), F.col(text).alias("t")).mapInArrow(_measure_batches, f"doc {kind}, {_TYPES}")


def _features(columns: dict):
    import numpy as np

    x = np.stack([np.asarray(columns[m], "f8") for m in MEASURES], axis=1)
    x[:, 0], x[:, 1] = np.log1p(x[:, 0]), np.log1p(x[:, 1])
    return x


class Mixture:
    """A fitted mixture: standardisation, weights, means, variances and the kind of each component."""

    def __init__(self, centre, scale, weights, means, variances, kinds=None):
        self.centre, self.scale, self.weights, self.means, self.variances, self.kinds = centre, scale, weights, means, variances, kinds

    def log_joint(self, x):
        import numpy as np

        z = (x - self.centre) / self.scale
        out = np.empty((len(z), len(self.weights)))
        for k in range(len(self.weights)):
            d = z - self.means[k]
            out[:, k] = np.log(self.weights[k]) - 0.5 * (np.log(2 * np.pi * self.variances[k]).sum() + (d * d / self.variances[k]).sum(1))
        return out

    def responsibilities(self, x):
        import numpy as np

        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        p = np.exp(joint - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top[:, 0] + np.log(total[:, 0]))


def _sums(batches: Iterator, model: Mixture) -> Iterator:
    """One row for a partition: log-likelihood, count and the sums of every component."""
    import numpy as np
    import pyarrow as pa

    k, d = model.means.shape
    total = np.zeros(2 + k * (1 + 2 * d))
    for batch in batches:
        x = _features({m: batch.column(m).to_numpy(zero_copy_only=False) for m in MEASURES})
        if not len(x):
            continue
        r, ll = model.responsibilities(x)
        z = (x - model.centre) / model.scale
        total += np.concatenate([[ll.sum(), len(x)], np.concatenate([r.sum(0)[:, None], r.T @ z, r.T @ (z * z)], axis=1).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])


def fit_mixture(stats: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mixture | None:
    """Expectation-maximisation over all rows of ``stats``; None for an empty table."""
    import numpy as np

    logs = {"n_words": F.log1p("n_words"), "mean_word_length": F.log1p("mean_word_length")}
    columns = [logs.get(m, F.col(m)) for m in MEASURES]
    row = stats.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, d = row[0], len(MEASURES)
    if not n:
        return None
    centre = np.array(row[1 : 1 + d], "f8")
    scale = np.maximum(np.array(row[1 + d :], "f8"), 1e-2)
    seeds = np.array([_vector(measure(t)) for _, t in EXAMPLES])
    model = Mixture(centre, scale, np.full(len(seeds), 1 / len(seeds)), (seeds - centre) / scale, np.full(seeds.shape, 1.0))
    before = None
    for _ in range(rounds):
        parts = stats.select(*MEASURES).mapInArrow(lambda it, m=model: _sums(it, m), "sums array<double>")
        folded = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # a fixed number of sums
        total = np.zeros(2 + len(seeds) * (1 + 2 * d))
        for r in folded:
            total[r.i] = r.v
        level = total[0] / max(1.0, total[1])
        m = total[2:].reshape(len(seeds), 1 + 2 * d)
        mass = m[:, :1] + 1e-3  # an empty component keeps its place
        means = (m[:, 1 : 1 + d] + 1e-3 * model.means) / mass
        variances = np.maximum((m[:, 1 + d :] + 1e-3 * (model.variances + model.means**2)) / mass - means**2, VARIANCE_FLOOR)
        model = Mixture(centre, scale, mass[:, 0] / mass.sum(), means, variances)
        if before is not None and abs(level - before) < tolerance:
            break
        before = level
    model.kinds = _kinds(model, seeds)
    return model


def _kinds(model: Mixture, seeds) -> list[str]:
    """Each component takes the kind of the examples it answers for; one that answers for none, that of the example nearest to it."""
    import numpy as np

    r, _ = model.responsibilities(seeds)
    kinds, names = [], [k for k, _ in EXAMPLES]
    z = (seeds - model.centre) / model.scale
    for c in range(len(model.weights)):
        votes: dict[str, float] = {}
        for kind, share in zip(names, r[:, c]):
            votes[kind] = votes.get(kind, 0.0) + float(share)
        best = max(votes, key=lambda v: (votes[v], v))
        if votes[best] < 0.5:
            away = (np.square(z - model.means[c]) / model.variances[c]).sum(1)
            best = names[int(away.argmin())]
        kinds.append(best)
    return kinds


def _classify_batches(batches: Iterator, model: Mixture) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = sorted({k for k, _ in EXAMPLES})
    at = np.array([names.index(k) for k in model.kinds])
    for batch in batches:
        x = _features({m: batch.column(m).to_numpy(zero_copy_only=False) for m in MEASURES})
        r, _ = model.responsibilities(x)
        by_kind = np.stack([r[:, at == i].sum(1) for i in range(len(names))], axis=1)
        kind = np.where(x[:, 0] == 0, names.index("junk"), by_kind.argmax(1))
        arrays = [*batch.columns, pa.array([names[i] for i in kind], pa.string()), pa.array(by_kind[:, names.index("prose")])]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "kind", "prose_probability"])


def classify_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, kind (prose, list, table, junk) and probability of prose for every document."""
    stats = cut(text_statistics(documents, key, text))
    model = fit_mixture(stats)
    kind = stats.schema["doc"].dataType.simpleString()
    if model is None:
        return stats.withColumn("kind", F.lit(None).cast("string")).withColumn("prose_probability", F.lit(None).cast("double"))
    return stats.mapInArrow(lambda it: _classify_batches(it, model), f"doc {kind}, {_TYPES}, kind string, prose_probability double")
