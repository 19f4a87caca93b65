"""Patterns and word lists.

Character classes are spelled out, as Java's shorthands for space, digit and word are narrower than those meant here.
"""

# What the results depend on.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
DIGIT = r"\p{Nd}"
WORD = r"[\p{L}\p{N}_]"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PAGE = rf"(?iu)^{WS}*##{WS}*page{WS}+{DIGIT}+{WS}*$"
ORPHAN = rf"(?iu)^{WS}*{DIGIT}+{WS}+bis{WS}*$"
ARTICLE = rf"(?iu)^{WS}*art(?:icle)?\.?{WS}*({DIGIT}+)(?:{WS}*[.-]?{WS}*(bis|ter|quater))?(?:{WS}*({DIGIT}+))?"
INLINE = rf"(?iu)([.;:?!»\"]{WS}*)(art\.?{WS}*{DIGIT}+)"
INLINE_START = rf"(?iu)^art\.?{WS}*{DIGIT}+"
HEADINGS = "LIVRE|TITRE|CHAPITRE|SECTION|PREMIERE PARTIE|DEUXIEME PARTIE|TROISIEME PARTIE|QUATRIEME PARTIE"
HEADING = rf"(?iu)^{WS}*(?:{HEADINGS})\b"
#: Eight words at most; possessive, so long texts fail after the ninth.
FEW_WORDS = rf"^{WS}*+(?:[^{WS[1:-1]}]++{WS}++){{0,7}}+[^{WS[1:-1]}]*+{WS}*+$"
BULLET = rf"^{WS}*(?:{DIGIT}+[°).-]|-{WS}|[a-zA-Z]\))"
#: What a text begins with if one of the patterns before can fit it (its first FRONT characters are enough to tell): a
#: pattern is looked for from every place of a text, though it can only fit the first one.
FRONT = 3
PAGE_FRONT = rf"^(?:#|{WS})"
ORPHAN_FRONT = rf"^(?:{DIGIT}|{WS})"
ARTICLE_FRONT = rf"(?iu)^(?:art|{WS})"
HEADING_FRONT = rf"(?iu)^(?:{'|'.join(sorted({x[:3] for x in HEADINGS.split('|')}))}|{WS})"
BULLET_FRONT = rf"^(?:{DIGIT}|-|[a-zA-Z]\)|{WS})"
#: More than eight words among the first MANY_FRONT characters, so that no more are looked at.
MANY_FRONT = 160
MANY_WORDS = rf"^{WS}*+(?:[^{WS[1:-1]}]++{WS}++){{8}}[^{WS[1:-1]}]"
REFERENCE = rf"(?iu)\bart(?:icle)?\.?{WS}*([0-9]+(?:{WS}*(?:bis|ter|quater))?)\b"
TOKEN = rf"[{LATIN}']+"
CONSONANTS = "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5,}"
ROMAN = "[IVXLCDMivxlcdm]"
#: Tokens of consonants alone, and tokens of one letter that is no Roman number, found without taking tokens apart.
VOWELLESS = rf"(?<![{LATIN}']){CONSONANTS}+(?![{LATIN}'])"
SINGLE = rf"(?<![{LATIN}'])(?!{ROMAN})[{LATIN}'](?![{LATIN}'])"
#: Four single letters or more, in a row. Each step looks on to the next letter and never comes back, so neither time nor
#: the stack grows with a run more than in proportion.
CLUSTER = rf"(?:\b[{LATIN}]{WS}++(?=[{LATIN}]\b)){{3,}}+[{LATIN}]\b"
BAD = r"""[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}.,;:!?()\[\]{}%/\-+'"°ªº€$£]"""
#: Lines are compared in their normal form, which has no curly quotes or long dashes.
EDITORIAL = ["CODE PENAL", "4eme Edition", "4ème Edition", "DEPOT LEGAL 3388 - 2004", "ISBN 9961 - 41 - 045 - 9", "Les Editions", "de l'O. N. T. E", "CO"]
COVER_LINES = 40
COVER_PREFIXES = ["DEPOT LEGAL", "ISBN"]
REASONS = ["high_single_char_token_ratio", "spaced_letter_clusters_detected", "many_words_without_vowels", "unexpected_characters"]
CRITICAL = ["spaced_letter_clusters_detected", "unexpected_characters"]
LEVELS = ["livre", "titre", "chapitre", "section"]
LOW_CONFIDENCE = ["tier c", "quarantine", "low confidence", "uncertain", "expert mode"]
SYNONYMS = {
    "theft": ["vol"],
    "steal": ["vol"],
    "penalty": ["peine"],
    "penalties": ["peines"],
    "sentence": ["peine"],
    "punishment": ["peine"],
    "crime": ["infraction"],
    "law": ["loi"],
    "judge": ["magistrat"],
    "prison": ["emprisonnement"],
    "fine": ["amende"],
    "attempt": ["tentative"],
    "state": ["etat"],
}
TIER_REASONS = {"A": "trusted_high_confidence", "B": "review_medium_confidence", "C": "quarantine_low_confidence"}
WARN_B = "Fallback to tier B was needed because tier A confidence was limited."
WARN_C = "Tier C was included. Treat the answer as low confidence."
WARN_NONE = "No relevant legal context was retrieved."
WARN_CITATION = "No verifiable citation in model output; attached top retrieved articles."
ROUTING = "use A first, fallback to B, use C only when explicitly requested"
