"""Word lists, question patterns and constants that results depend on."""

# Words that the recall tokenizer leaves out.
STOPWORDS = (
    "o", "a", "os", "as", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "é", "foi", "são", "e", "ou", "que", "para", "por",
    "com", "sem", "um", "uma", "the", "an", "of", "in", "on", "at", "is", "was", "were", "are", "and", "or", "that", "for", "by", "with", "to",
)

# Single words that count as a negation.
NEGATIONS = (
    "não", "nao", "nunca", "jamais", "rejeitou", "rejeita", "recusou", "recusa", "negou", "nega", "reprovou", "reprova", "detestou", "odeia",
    "abomina", "nenhum", "nenhuma", "impossível", "impossivel", "sem", "not", "no", "never", "rejected", "refused", "denied", "hates", "detests",
    "abominates", "dislikes", "neither", "none", "impossible", "without", "jamás", "rechazó", "rechaza", "negó", "niega", "odia", "detesta",
    "ninguno", "ninguna", "imposible", "sin",
)

# Words that speak for a language.
LANGUAGE_WORDS = {
    "pt": ("não", "que", "para", "com", "uma", "como", "foi", "são", "quem", "onde", "quando", "por"),
    "en": ("the", "what", "where", "when", "who", "why", "how", "is", "did", "are", "with", "for", "does"),
    "es": ("qué", "quién", "dónde", "cuándo", "cómo", "es", "fue", "con", "para", "pide", "pides", "hace", "vive", "sabe"),
}

# Names, times and places in free text.
NAME_PATTERN = "^[A-ZÁÉÍÓÚÂÊÔÃÕÇ][a-záéíóúâêôãõç]{2,}$"
NOT_NAMES = ("the", "que", "com", "para", "por", "uma", "não")
DAY_WORDS = ("hoje", "ontem", "anteontem", "amanhã", "agora")
WEEKDAYS = ("segunda", "terça", "quarta", "quinta", "sexta", "sábado", "domingo")
PLACE_WORDS = ("suporte", "vendas", "infra", "dev", "family", "preferences", "calendar", "habits", "trabalho", "casa")
GENERIC_WHATS = ("undefined", "none", "null", "unknown", "n/a", "")

# Question patterns by language, tried in this order on the lower-cased
# question; the first that is found decides. With each: its kind. \w is any Unicode
# letter, digit or underscore.
QUESTIONS = {
    "pt": (
        (r"quem\s+(?:é|são|foi|era)\s+(?:o|a|os|as)?\s*([\w\s\-]+?)\s*\??\s*$", "identity"),
        (r"o\s+que\s+(?:o|a|os|as)?\s*([\w\-]+)\s+(fez|faz|disse|diz|pediu|pede|comprou|compra|vendeu|vende|gostou|gosta|reclamou|reclama|quis|quer|precisa|fazia|tinha|tem)\s*\??\s*$", "action"),
        (r"o\s+que\s+(?:aconteceu|ocorreu|rolou)\s+com\s+(?:o|a|os|as)?\s*([\w\s]+?)\s*\??\s*$", "action"),
        (r"onde\s+(?:o|a|os|as)?\s*([\w\-]+)\s+(mora|morou|morava|trabalha|trabalhou|está|estava|fica|ficou|vai|foi)\s*\??\s*$", "location"),
        (r"onde\s+(?:é|fica|aconteceu|ocorreu)\s+(?:a|o|os|as)?\s*([\w\s]+?)\s*\??\s*$", "location"),
        (r"quando\s+(?:foi|aconteceu|ocorreu|é|será|era)\s+(?:a|o|os|as)?\s*([\w\s]+?)\s*\??\s*$", "temporal"),
        (r"quando\s+(?:o|a|os|as)?\s*([\w]+)\s+(fez|faz|disse|pediu|comprou|vendeu|gostou|reclamou)\s*(?:.*)$", "temporal who"),
        (r"por\s+que\s+(?:o|a|os|as)?\s*([\w\-]+)\s+([\w\-]+)\s*\??\s*$", "causal"),
        (r"por\s+que\s+(?:aconteceu|ocorreu|reclamou|pediu|fez)", "causal"),
        (r"o\s+que\s+(?:você|tu|vc)\s+(?:sabe|conhece)\s+sobre\s+(?:o|a|os|as)?\s*([\w\s]+?)\s*\??\s*$", "general"),
        (r"fale\s+sobre\s+(?:o|a|os|as)?\s*([\w\s]+?)\s*\??\s*$", "general"),
        (r"conte\s+sobre\s+(?:o|a|os|as)?\s*([\w\s]+?)\s*\??\s*$", "general"),
    ),
    "en": (
        (r"who\s+is\s+(?:the\s+)?([\w\s\-]+?)\s*\??\s*$", "identity"),
        (r"what\s+is\s+([\w\s\-]+?)\s*\??\s*$", "identity"),
        (r"tell\s+me\s+about\s+([\w\s]+?)\s*\??\s*$", "identity"),
        (r"what\s+(?:did|does|is|are)\s+(?:the\s+)?([\w]+)\s+(do|eat|buy|sell|want|say|tell|have|need|like|love|hate|know|see|ask|find|get|make|take|give|show|use|try|go|come|leave|bring|send|write|read|call|start|stop|begin|finish|complete|reach|hold|keep|put|set|turn|move|run|walk|talk|play)\s*\??\s*$", "action"),
        (r"what\s+happened\s+(?:to|with)\s+(?:the\s+)?([\w\s]+?)\s*\??\s*$", "action"),
        (r"where\s+(?:does|did|is|are)\s+(?:the\s+)?([\w]+)\s+(live|work|stay|go|come|be)\s*\??\s*$", "location"),
        (r"where\s+(?:is|are|was|were)\s+(?:the\s+)?([\w\s]+?)\s*\??\s*$", "location"),
        (r"when\s+(?:did|is|was|were)\s+(?:the\s+)?([\w\s]+?)\s*\??\s*$", "temporal"),
        (r"when\s+(?:did|does)\s+(?:the\s+)?([\w]+)\s+(do|eat|buy|sell|say|go|come)\s*(?:.*)$", "temporal who"),
        (r"why\s+(?:did|does|is|are)\s+(?:the\s+)?([\w\-]+)\s+([\w\-]+)\s*\??\s*$", "causal"),
        (r"why\s+(?:did|does|is|are|happened)", "causal"),
        (r"what\s+(?:do\s+you|can\s+you)\s+(?:know|tell\s+me)\s+about\s+(?:the\s+)?([\w\s]+?)\s*\??\s*$", "general"),
        (r"tell\s+me\s+(?:about|everything\s+about)\s+([\w\s]+?)\s*\??\s*$", "general"),
    ),
    "es": (
        (r"¿?quién\s+(?:es|son|fue|era)\s+(?:el|la|los|las)?\s*([\w\s\-]+?)\s*\??\s*$", "identity"),
        (r"¿?qué\s+(?:hizo|hace|dijo|dice|pidió|pide|compró|compra|vendió|vende|quiere|necesita|le\s+gusta|odia|sabe)\s+(?:el|la|los|las)?\s*([\w]+)\s*\??\s*$", "action"),
        (r"¿?qué\s+(?:pasó|sucedió|ocurrió)\s+con\s+(?:el|la|los|las)?\s*([\w\s]+?)\s*\??\s*$", "action"),
        (r"¿?dónde\s+(?:vive|vivió|trabaja|trabajó|está|estuvo|queda|quedó|va|fue)\s+(?:el|la|los|las)?\s*([\w\-]+)\s*\??\s*$", "location"),
        (r"¿?dónde\s+(?:es|está|queda|quedó|ocurrió)\s+(?:el|la|los|las)?\s*([\w\s]+?)\s*\??\s*$", "location"),
        (r"¿?cuándo\s+(?:pasó|sucedió|ocurrió|fue|será|era)\s+(?:el|la|los|las)?\s*([\w\s]+?)\s*\??\s*$", "temporal"),
        (r"¿?cuándo\s+(?:el|la|los|las)?\s*([\w]+)\s+(hizo|dijo|compró)\s*(?:.*)$", "temporal who"),
        (r"¿?por\s+qué\s+(?:el|la|los|las)?\s*([\w\-]+)\s+([\w\-]+)\s*\??\s*$", "causal"),
        (r"¿?qué\s+(?:sabes|conoces)\s+sobre\s+(?:el|la|los|las)?\s*([\w\s]+?)\s*\??\s*$", "general"),
        (r"¿?háblame\s+de\s+(?:el|la|los|las)?\s*([\w\s]+?)\s*\??\s*$", "general"),
    ),
}

# Confidence of each kind of question.
CONFIDENCE = {"identity": 0.9, "action": 0.85, "location": 0.8, "temporal": 0.8, "temporal who": 0.75, "causal": 0.75, "general": 0.6}


def unicode_words(pattern: str) -> str:
    """\\w as classes that Java's, RE2's and DuckDB's engines read alike; every \\w stands in brackets."""
    return pattern.replace(r"\w", r"\p{L}\p{N}_")
