"""Results depend on these lists, tables and version texts being exactly so."""

VERSIONS = {
    "engine": "0.1.0",
    "normalization": "1.0.3",
    "retrieval_profile": "1.0.3",
    "pruning_profile": "1.1.1",
    "score": "1.3.6",
    "token_analysis": "1.1.9",
    "transliteration": "1.0.2",
    "phonetic": "1.0.0",
}

#: Latin letters without a canonical decomposition and what they fold to.
SPECIAL_LATIN = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ŋ": "n"}

SCRIPTS = {
    "Latn": r"\p{IsLatin}",
    "Cyrl": r"\p{IsCyrillic}",
    "Grek": r"\p{IsGreek}",
    "Arab": r"\p{IsArabic}",
    "Hebr": r"\p{IsHebrew}",
    "Deva": r"\p{IsDevanagari}",
    "Hani": r"\p{IsHan}",
    "Zyyy": r"[\p{IsCommon}\p{IsInherited}]",
}

LEGAL_FORMS = (
    "bv nv ltd limited llc gmbh ag sas sarl spa sl group company co corporation corp holding holdings inc llp plc oy ab sa srl kg kgaa"
).split()

WEAK_WORDS = (
    "drinks beverages beverage food shop store company group premium original ginger spritz beer wine cafe café bar official international soft "
    "business coffee brand water juice organic natural fresh quality collection "
    "partners solutions technologies technology trading consulting ventures laboratories laboratory industries industry enterprises enterprise "
    "services service systems system networks network capital global worldwide"
).split()

FUNCTION_WORDS = (
    "van von der ter de den des du het the of and und et une un una la le les el y da di del della ki "
    "my our your their his her its this that these those"
).split()

CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}

#: Weighted edits: id, one side, other side, cost, locales (None: all); both directions count.
EDIT_RULES = (
    ("s-z", "s", "z", 0.25, ("nl", "de", "en", "generic")),
    ("c-k", "c", "k", 0.25, None),
    ("ph-f", "ph", "f", 0.2, None),
    ("f-ph", "f", "ph", 0.2, None),
    ("qu-kw", "qu", "kw", 0.2, None),
    ("ij-y", "ij", "y", 0.2, ("nl",)),
    ("y-ij", "y", "ij", 0.2, ("nl",)),
    ("ck-k", "ck", "k", 0.2, None),
    ("x-ks", "x", "ks", 0.35, None),
)

TRANSLATIONS = {
    "lion": ["lowe", "löwe", "leeuw"],
    "lowe": ["lion", "leeuw"],
    "löwe": ["lion", "leeuw"],
    "leeuw": ["lion", "lowe", "löwe"],
    "sun": ["sonne", "zon", "sol"],
    "moon": ["mond", "luna"],
}

RELATED_CLASSES = ((32, 33), (9, 42), (25, 35), (29, 30), (16, 41), (5, 10))

STATUS_GROUPS = {
    "registered": ["REGISTERED", "REGISTERED_BY_WIPO", "ACCEPTED"],
    "expired": ["EXPIRED"],
    "withdrawn": ["WITHDRAWN"],
    "refused": ["REFUSED", "NOT_REGISTERED_BY_WIPO"],
    "cancelled": ["CANCELLED", "SURRENDERED", "REMOVED_FROM_REGISTER"],
    "pending": ["RECEIVED", "UNDER_EXAMINATION", "APPLICATION_PUBLISHED", "REGISTRATION_PENDING", "OPPOSITION_PENDING", "APPEAL_PENDING", "SUSPENDED"],
}

SOURCE_STATUSES = ["REGISTERED", "ACCEPTED"]

#: Greatest length of a bucket and the cap on each strategy's hits; beyond the last: 150.
STRATEGY_CAPS = ((3, 50), (5, 75), (10, 100), (20, 125))
LAST_CAP = 150
LENGTH_BUCKETS = ((3, "very_short"), (5, "short"), (10, "medium"), (20, "long"))

STRATEGIES = ["exact_forms", "transliteration", "trigram", "token", "phonetic"]

#: Letter patterns that hint at a language: locale, evidence code, pattern (case ignored).
LOCALE_PATTERNS = (
    ("nl", "PATTERN_NL_IJ", r"ij"),
    ("nl", "PATTERN_NL_HEID", r"heid\b"),
    ("nl", "PATTERN_NL_VAN", r"\bvan\b"),
    ("nl", "PATTERN_NL_ZO", r"-zo\b|zo\b"),
    ("de", "PATTERN_DE_SCH", r"sch"),
    ("de", "PATTERN_DE_UNG", r"ung\b"),
    ("de", "PATTERN_DE_STRASSE", r"straße|strasse"),
    ("fr", "PATTERN_FR_EAU", r"eau\b"),
    ("fr", "PATTERN_FR_QUE", r"que\b"),
    ("fr", "PATTERN_FR_EUX", r"eux\b"),
)

LOCALE_SCRIPTS = (
    ("und-x-phonetic", "SCRIPT_CYRL", r"\p{IsCyrillic}", 0.55),
    ("und", "SCRIPT_GREK", r"\p{IsGreek}", 0.35),
    ("und", "SCRIPT_LATN", r"\p{IsLatin}", 0.35),
    ("und-x-phonetic", "SCRIPT_HANS", r"\p{IsHan}", 0.55),
    ("und-x-phonetic", "SCRIPT_ARAB", r"\p{IsArabic}", 0.55),
)

#: Sentences by evidence code, in English and Dutch.
SENTENCES = {
    "en": {
        "exact_normalized": "The marks match after normalization ({proposedMark} vs {candidateMark}).",
        "exact_compact": "The compact forms of the marks are identical.",
        "exact_transliteration": "The marks match after transliteration to Latin.",
        "orthographic_high": "The marks are highly similar in spelling.",
        "orthographic_medium": "The marks show moderate orthographic similarity.",
        "phonetic_primary_match": "The primary phonetic keys of the marks match.",
        "phonetic_secondary_match": "The secondary phonetic keys of the marks match.",
        "phonetic_similar": "The marks sound similar when pronounced.",
        "token_dominant_overlap": "The dominant tokens of the marks overlap.",
        "token_prefix_overlap": "The marks share a common prefix token.",
        "token_suffix_overlap": "The marks share a common suffix token.",
        "token_core_overlap": "The marks share a distinctive core element.",
        "token_noise_only": "Overlap appears only on descriptive, legal-form, or other non-distinctive elements.",
        "token_core_empty": "No distinctive core element could be identified in one or both marks.",
        "token_secondary_overlap": "The marks share an additional distinctive token beyond the primary dominant.",
        "conceptual_translation": "The marks may convey a similar meaning via translation (e.g. LION/LÖWE).",
        "goods_class_overlap": "The Nice classes of the marks overlap.",
        "goods_missing": "Goods and services text is incomplete; class overlap was used where available.",
        "retrieval_multi_strategy": "The candidate was found by multiple retrieval strategies.",
        "descriptive_only": "Similarity appears driven mainly by descriptive or weak tokens.",
        "missing_data": "Some comparison inputs were missing; confidence is reduced.",
    },
    "nl": {
        "exact_normalized": "De merken komen overeen na normalisatie ({proposedMark} vs {candidateMark}).",
        "exact_compact": "De compacte vormen van de merken zijn identiek.",
        "exact_transliteration": "De merken komen overeen na transliteratie naar Latijn.",
        "orthographic_high": "De merken lijken sterk op elkaar in spelling.",
        "orthographic_medium": "De merken vertonen matige orthografische gelijkenis.",
        "phonetic_primary_match": "De primaire fonetische sleutels van de merken komen overeen.",
        "phonetic_secondary_match": "De secundaire fonetische sleutels van de merken komen overeen.",
        "phonetic_similar": "De merken klinken vergelijkbaar bij uitspreken.",
        "token_dominant_overlap": "De dominante tokens van de merken overlappen.",
        "token_prefix_overlap": "De merken delen een gemeenschappelijk prefix-token.",
        "token_suffix_overlap": "De merken delen een gemeenschappelijk suffix-token.",
        "token_core_overlap": "De merken delen een onderscheidend kernelement.",
        "token_noise_only": "Overlap lijkt alleen op beschrijvende, rechtsvorm- of andere niet-onderscheidende elementen.",
        "token_core_empty": "In een of beide merken kon geen onderscheidend kernelement worden vastgesteld.",
        "token_secondary_overlap": "De merken delen een extra onderscheidend token naast het primaire dominante token.",
        "conceptual_translation": "De merken kunnen een vergelijkbare betekenis overbrengen via vertaling (bijv. LION/LÖWE).",
        "goods_class_overlap": "De Nice-klassen van de merken overlappen.",
        "goods_missing": "Goederen- en dienstentekst is onvolledig; klasse-overlap werd gebruikt waar beschikbaar.",
        "retrieval_multi_strategy": "De kandidaat werd gevonden via meerdere retrieval-strategieën.",
        "descriptive_only": "Gelijkheid lijkt vooral gedreven door beschrijvende of zwakke tokens.",
        "missing_data": "Sommige vergelijkingsinvoer ontbrak; het vertrouwen is verlaagd.",
    },
}

STAGE_WEIGHTS = {
    "validate": 5,
    "normalize": 5,
    "exact_retrieval": 12,
    "transliteration_retrieval": 6,
    "trigram_retrieval": 12,
    "phonetic_retrieval": 10,
    "union": 5,
    "pruning": 10,
    "comparison": 15,
    "scoring": 8,
    "attorney_analysis": 10,
    "complete": 2,
}
