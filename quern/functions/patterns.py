"""Patterns, phrases and messages that results depend on, stated plainly.

Patterns are Java ones; FLAGS makes them ignore case beyond ASCII and take letters and white
space of all scripts, as the modelled service does.
"""

FLAGS = "(?iuU)"

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INVISIBLE = r"[​‌‍⁠﻿­]"

# boilerplate of gazette pages
BOILERPLATE = [
    r"УНИВЕРЗИТЕТСКИ\s+ГЛАСНИК",
    r"Број\s+\d+,\s*\w+\s+\d{4}",
    r"Ознака:\s*\S+",
    r"Верзија:\s*\S+",
    r"Страница\s*\d+\s*/\s*\d+",
    r"Овој документ е сопственост.*?авторски права\.",
    r"Забрането е\s+фотографирање.*?запис\.",
]

# phrases in documents that try to instruct a model
CORPUS_INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(the\s+)?(above|previous|prior)",
    r"forget\s+(all\s+)?(previous|prior)\s+instructions?",
    r"you\s+are\s+now\b",
    r"act\s+as\s+(a|an)\b",
    r"pretend\s+to\s+be\b",
    r"new\s+instructions?\s*:",
    r"system\s*prompt",
    r"developer\s+message",
    r"do\s+not\s+follow\s+the\s+system",
    r"reveal\s+your\s+(instructions|prompt)",
    r"игнорирај\s+ги\s+(претходните|инструкциите|горните)",
    r"заборави\s+ги\s+претходните",
    r"нови\s+инструкции\s*:",
    r"системски\s+промпт",
    r"однесувај\s+се\s+како",
]
CORPUS_MARK = "[отстранета инструкција]"

# the shorter list for questions
QUESTION_INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(the\s+)?(above|previous|prior)",
    r"you\s+are\s+now\b",
    r"act\s+as\s+(a|an)\b",
    r"new\s+instructions?\s*:",
    r"system\s*prompt",
    r"developer\s+message",
    r"reveal\s+your\s+(instructions|prompt)",
    r"игнорирај\s+ги\s+(претходните|инструкциите|горните)",
    r"заборави\s+ги\s+претходните",
    r"системски\s+промпт",
]
QUESTION_MARK = "[отстрането]"

ARTICLE = r"Член\s+\d+[а-я]?\b"
INTRO_SECTION = "вовед"
PART_SECTION = "дел"

GREETINGS = [
    r"здраво", r"здр", r"ало", r"еј", r"хеј", r"поздрав", r"добар\s+ден", r"добро\s+утро", r"добра\s+вечер",
    r"кој\s+си", r"ко\s+си", r"што\s+си", r"што\s+(можеш|правиш|нудиш)", r"со\s+што\s+(можеш|помагаш)",
    r"фала", r"благодар", r"zdravo", r"koj\s+si", r"sto\s+mozes", r"fala", r"hi", r"hello", r"hey",
    r"who\s+are\s+you", r"what\s+can\s+you", r"thanks", r"thank\s+you",
]

PROMPT_REQUESTS = [
    r"system\s*prompt",
    r"developer\s+(message|prompt)",
    r"initial\s+(instructions?|prompt)",
    r"(reveal|show|print|repeat|give|display|output|share|tell)\s+(me\s+)?(your|the)?\s*(system\s*)?(prompt|instructions?|rules?|guidelines?|configuration)",
    r"(repeat|print|output|say)\s+(the\s+)?(text|words|everything)\s+above",
    r"what\s+(are|were)\s+your\s+(instructions?|rules?|system\s*prompt)",
    r"verbatim",
    r"системск\w*\s+промпт",
    r"(покажи|кажи|издиктирај|повтори|испечати|откриј|сподели|дај)\s+(ми\s+)?(ги\s+)?(твоите|своите)?\s*(инструкции|правила|промпт|упатства|насоки)",
    r"(повтори|испечати|кажи)\s+(го\s+)?(текстот|зборовите|сето)\s+(погоре|над)",
    r"кои\s+се\s+(твоите|вашите)\s+(инструкции|правила)",
]

AUTHORSHIP = [
    r"кој\s+(те|ве)\s+(направи|изработи|создаде|создал|напиша|напра[вј]и|(ис)?програмира|кодира|разви|дизајнира|осмисли|конструира)",
    r"кој\s+стои\s+(зад|позади)\s+(тебе|те|вас)",
    r"кој\s+(е\s+)?(твој|твојот|вашиот|ваш)\s+(основач|автор|творец|креатор)",
    r"koj\s+te\s+(napravi|izraboti|sozdade|(is)?programira|kodira)",
    r"koj\s+stoi\s+(zad|pozadi)\s+(tebe|te)",
    r"who\s+(made|created|built|developed|designed|programmed|coded)\s+you",
    r"who\s+is\s+behind\s+you",
    r"who\s+is\s+your\s+(creator|founder|developer|author|maker)",
]

# languages with a directive of their own besides mk and en
LANGUAGES = {"tr": "Turkish", "de": "German", "sq": "Albanian", "fr": "French", "es": "Spanish", "it": "Italian"}

# messages of fixed routes: placeholders that a deployment sets
REFUSALS = {
    "mk": "Не можам да ги споделам внатрешните инструкции.",
    "en": "I can't share the internal instructions.",
    "tr": "Dahili talimatları paylaşamam.",
    "de": "Ich kann die internen Anweisungen nicht teilen.",
    "sq": "Nuk mund t'i ndaj udhëzimet e brendshme.",
}
NO_INFORMATION = "Немам информација за тоа во достапната документација."
GREETING_REPLY = "Здраво, како може да ви помогнам?"
AUTHOR_REPLY = "This assistant was built by its maintainers."

COLUMNS_LABEL = "Колони: "
CONTINUED = "(продолжение)"
ROW_NUMBER_COLUMN = "бр"
PAGE_LABEL = "стр."

# words that tell languages apart where no detector is plugged in
STOPWORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "that", "for", "with", "are"],
    "de": ["der", "die", "und", "ist", "nicht", "ein", "eine", "mit", "den", "von"],
    "fr": ["le", "les", "et", "est", "une", "des", "que", "pour", "dans", "qui"],
    "es": ["el", "los", "y", "es", "una", "que", "por", "con", "para", "del"],
    "it": ["il", "gli", "e", "che", "di", "per", "una", "con", "non", "sono"],
    "tr": ["ve", "bir", "bu", "ne", "için", "ile", "mi", "nasıl", "çok", "var"],
    "sq": ["dhe", "një", "të", "për", "është", "nga", "me", "si", "ku", "çfarë"],
}


def any_of(patterns: list[str]) -> str:
    return FLAGS + "(" + "|".join(patterns) + ")"
