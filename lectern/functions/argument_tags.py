"""Argument tags of a card by keyword rules over its tag and, for some, its whole text.

Some 400 keywords are looked for by RE2 (in Arrow), which reads a text once however many it is asked for, and whose
word boundaries are those of ASCII letters, digits and underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import text

#: Fixed values: (label, where to look, pattern over lower-case text), in the order of the labels.
RULES = (
    ("politics da", "tag", r"\bpolitics\b|\bptx\b|political capital|congressional|partisan|senate|filibuster|electoral|midterm|bipartisan"),
    ("heg da", "tag", r"\bheg\b|hegemony|unipolarity|power projection|primacy|military dominance|leadership"),
    ("nfu cp", "full", r"\bnfu\b|no.first.use|first.use policy|launch.on.warning|nuclear use|nuclear employment"),
    ("nuclear war", "tag", r"nuclear war|nuclear conflict|prolifer|deterrence|arms race|warhead|nuke|escalat|nuclear exchange"),
    ("hedge", "full", r"\bhedg(e|ing)\b|hedge strategy|nuclear hedge|extended deterrence|assured destruction|second strike"),
    ("cil cp", "full", r"\bcil\b|customary international law|international custom|international norm|jus cogens|opinio juris"),
    ("climate da", "tag", r"\bclimate\b|warming|emissions|carbon|greenhouse|sea level|temperature rise|decarboniz"),
    ("spending da", "tag", r"\bspending\b|deficit|federal budget|debt ceiling|national debt|austerity"),
    ("federalism da", "tag", r"\bfederalism\b|states rights?|preemption|devolution|state sovereignty"),
    ("elections da", "tag", r"\belections?\b|electoral|swing state|polling|campaign|voter"),
    ("trade da", "tag", r"\btrade\b|tariff|import|export|wto|trade deficit|protectionism"),
    ("relations da", "tag", r"relations|alliance|diplomatic|bilateral|multilateral|foreign policy|soft power"),
    ("bioweapons da", "tag", r"\bbiow(eapon)?|bioterror|pandemic|pathogen|infectious disease"),
    ("cyber da", "tag", r"\bcyber\b|hack|ransomware|critical infrastructure|cyberattack"),
    ("democracy da", "tag", r"democracy|democratic backslid|authoritarianism|autocratic|free press"),
    ("energy da", "tag", r"\benergy\b|grid|electricity|power sector|renewable|fossil fuel"),
    ("human rights da", "tag", r"human rights|humanitarian|atrocity|genocide|r2p"),
    ("immigration da", "tag", r"immigra|border|asylum|refugee|undocumented|migrant"),
    ("states cp", "tag", r"\bstates\b.*\bcp\b|\bcp\b.*\bstate(s)?\b|fifty.state"),
    ("international cp", "tag", r"\binternational\b.*\bcp\b|\bcp\b.*international|multilateral cp"),
    ("process cp", "tag", r"process cp|procedural cp|study cp|commission|pilot program"),
    ("consult cp", "tag", r"consult(ation)? cp|consult (allies|nato|congress)"),
    ("conditions cp", "tag", r"conditions? cp|conditioned on"),
    ("delay cp", "tag", r"delay cp|sun.?set|revisit|phase.in"),
    ("cap k", "full", r"capitalism|neoliberal|commodity form|surplus value|profit motive|\bcap k\b|capital accumulation|class struggle|bourgeois|wage labor|commodif"),
    ("set col k", "full", r"settler colonialism|indigenous|decoloniz|land back|native (people|nation|sovere)|colonizer|first nation|tribal"),
    ("afropess k", "full", r"afropessimism|anti.?blackness|social death|fungibility|slaveholder|middle passage|afro.pessimism"),
    ("anthro k", "full", r"anthropocentr|human exceptionalism|speciesism|nonhuman|more.than.human|posthuman|animal rights|multispecies"),
    ("biopower k", "full", r"\bbiopower\b|biopoliti|governmentality|\bfoucault\b|discipline and punish|subject formation"),
    ("psychoanalysis k", "full", r"psychoanaly|lacan|\bzizek\b|\bdrive\b|jouissance|the real|objet a|lack|symbolic order"),
    ("queer theory k", "full", r"queer theory|heteronormativity|homonationalism|\blgbt|\bgender binary|cis.?norm|queerness"),
    ("feminist k", "full", r"\bfeminis[mt]\b|patriarchy|misogyny|gender.based violence|rape culture|reproductive justice"),
    ("heidegger k", "full", r"\bheidegger\b|\bdasein\b|\benframing\b|being and time|ontological difference|thrownness"),
    ("nietzsche k", "full", r"\bnietzsche\b|will to power|ressentiment|eternal recurrence|overman|\bubermensch\b"),
    ("disability k", "full", r"\bableism\b|disability studies|crip theory|normative body|mad studies"),
    ("neolib k", "full", r"\bneoliberal(ism)?\b|market fundamentalism|washington consensus|structural adjustment"),
    ("tech k", "tag", r"\btechnology\b.*\bk\b|\btechno.?log(y|ical)\b.*critique|instrumental reason|tech k|technoscience"),
    ("security k", "tag", r"\bsecurit(y|ization)\b.*\bk\b|\bsecuritiz|existential threat framing|securitization theory"),
    ("orientalism k", "full", r"orientalism|\bsaid\b|colonial gaze|othering|third world"),
    ("militarism k", "full", r"militarism|war machine|military.industrial|martial|warrior culture"),
    ("fairness", "tag", r"\bfairness\b|\bfair\b|adequate prep|pre.?round prep|limits|ground"),
    ("education", "tag", r"\beducation\b|educational value|topic education|research burden"),
    ("condo", "full", r"conditionality|conditional advocacy|\bcondo\b"),
    ("topicality", "tag", r"\btopicality\b|\bt-\b|extra.topical|resolutional|definitions?|limits"),
    ("PICs", "full", r"\bpics?\b|plan.inclusive counterplan"),
    ("dispo", "full", r"\bdispo\b|dispositional"),
    ("RVI", "full", r"\brvi\b|reverse (voting|voter)"),
    ("disclosure theory", "tag", r"disclosure|open.?source|posted|wiki|backfile"),
    ("spec", "tag", r"\bspec\b|specification|actor spec|mechanism spec"),
    ("severance", "tag", r"\bseverance\b|intrinsicness|spike"),
    ("util", "full", r"utilitarianism|utilitarian|maximize (welfare|utility|well.?being|happiness)|greatest (good|number)|aggregate welfare"),
    ("kant", "full", r"\bkant\b|deontolog|categorical imperative|humanity as an end|kingdom of ends|korsgaard|formula of humanity"),
    ("rawls", "full", r"\brawls\b|veil of ignorance|difference principle|justice as fairness|original position"),
    ("virtue ethics", "full", r"virtue ethics|aristotle|\beudaimonia\b|character.based|phronesis|flourishing"),
    ("care ethics", "full", r"care ethics|relational ethics|carol gilligan|ethics of care|nell noddings"),
    ("contractualism", "full", r"contractualism|\bscanlon\b|reasonable rejection|what we owe to each other"),
    ("contractarianism", "full", r"contractarianism|social contract|\bhobbes\b|\blocke\b|\brousseau\b"),
    ("moral skepticism", "full", r"moral skeptic|nihilism|error theory|non.?cognitivism|moral realism|amoralism"),
    ("ross", "full", r"\bross\b|prima facie duties|pro tanto|moral pluralism|w\.d\. ross"),
    ("levinas", "full", r"\blevinas\b|face of the other|alterity|infinite responsibility"),
    ("parfit", "full", r"\bparfit\b|personal identity|reasons and persons|reductionism about persons"),
    ("pogge", "full", r"\bpogge\b|global justice|world poverty|negative duty"),
    ("skep trigger", "tag", r"skep(ticism)? trigger|\bskep\b|default to skep|moral skept"),
    ("a priori", "full", r"\ba priori\b"),
    ("presumption", "full", r"\bpresumption\b|presumptively|tie.?goes"),
    ("framing", "tag", r"framing (argument|trick|issue)|meta.?level|prior question"),
    ("permissibility", "full", r"permissibility|permissive|permissibilism"),
    ("nonproliferation", "full", r"\bnonprolifer|nonprolifer|arms control|disarmament|npt\b|start treaty"),
    ("arms control", "full", r"\barms control\b|disarmament|new start|salt\b|inf treaty"),
    ("surveillance", "full", r"\bsurveillance\b|nsa|mass surveillance|data collection|privacy"),
    ("AI", "full", r"\bai\b|artificial intelligence|machine learning|autonomous weapon|lethal autonomous"),
)
#: The first label, by its tag, or by its body where the tag names a disadvantage.
ECONOMY, ECONOMY_BODY, NAMES_DISAD = r"\becon(omy)?\b|gdp|recession|growth|trade war|inflation|unemploy|fiscal|monetary|market crash|financial crisis", r"\becon(omy)?\b|gdp|recession", r"\b(da|disad|disadvantage)\b"


def fitting(texts: pa.Array, patterns: list[str]) -> np.ndarray:
    """Texts x patterns: which fit. All patterns are one at first; each half of them is asked for in the texts that fit the whole."""
    out = np.zeros((len(texts), len(patterns)), bool)

    def look(some: list[int], at: np.ndarray, x: pa.Array) -> None:
        fits = pc.match_substring_regex(x, "|".join(patterns[k] for k in some))
        at, x = at[fits.to_numpy(zero_copy_only=False)], x.filter(fits)
        if len(some) == 1:
            out[at, some[0]] = True
        elif len(at):
            look(some[: len(some) // 2], at, x)
            look(some[len(some) // 2 :], at, x)

    look(list(range(len(patterns))), np.arange(len(texts)), texts)
    return out


def argument_tags(tag: Column, body: Column) -> Column:
    """Labels of all rules that fit; `neolib k` only where `cap k` doesn't."""
    in_tag, in_full = ([r for r in RULES if r[1] == where] for where in ("tag", "full"))
    labels = ["econ da", *(label for label, _, _ in RULES)]

    @F.arrow_udf("array<string>")
    def tags(t: pa.Array, b: pa.Array) -> pa.Array:
        of_tag = fitting(t, [ECONOMY, NAMES_DISAD, *(p for _, _, p in in_tag)])
        of_full = fitting(pc.binary_join_element_wise(t, b, pa.scalar(" ", t.type)), [p for _, _, p in in_full])
        fits = dict(zip([label for label, _, _ in in_tag], of_tag.T[2:])) | dict(zip([label for label, _, _ in in_full], of_full.T))
        fits["econ da"] = of_tag[:, 0].copy()
        disad = np.flatnonzero(of_tag[:, 1])
        fits["econ da"][disad] |= fitting(b.take(pa.array(disad)), [ECONOMY_BODY])[:, 0]
        fits["neolib k"] = fits["neolib k"] & ~fits["cap k"]
        row, which = np.nonzero(np.stack([fits[label] for label in labels], 1))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(t) + 1)), pa.int32()), pa.array(labels).take(pa.array(which)))

    return tags(F.lower(text(tag)), F.lower(text(body)))
