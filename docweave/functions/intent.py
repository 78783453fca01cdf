"""Rule-based query intent, as one expression per classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import text as tx

CONVERSATION = "CONVERSATION"
DOCUMENT = "DOCUMENT_QUERY"
CONCISE = "CONCISE_QUERY"
SEARCH = "DOCUMENT_SEARCH"

# Patterns per category, tried in this order.
SEARCH_PATTERNS = [
    r"^find\s+.+",
    r"^search\s+for\s+.+",
    r"^where\s+can\s+i\s+find\s+.+",
    r"^locate\s+.+",
    r"^show\s+me\s+.+\s+(about|related\s+to)\s+.+",
    r"^list\s+all\s+.+",
    r"^get\s+information\s+(about|on)\s+.+",
]
CONCISE_PATTERNS = [
    r"^(summarize|summarise|brief|concise|short|tl;dr|tldr|summary)\s+.+",
    r".+\s+in\s+(one|1|a|few)\s+(sentence|sentences|line|lines|paragraph|paragraphs|words).*$",
    r"^(explain|describe|define|what\s+is)\s+.+\s+(briefly|concisely|in short).*$",
    r"^(give|provide)\s+(me\s+)?(a\s+)?(brief|short|concise|quick|simple)\s+(summary|description|explanation|overview|answer)\s+.+$",
    r"^(can\s+you\s+)?(quickly|briefly|concisely)\s+(tell|explain|describe|summarize)\s+.+$",
    r"^short\s+(answer|explanation|description)\s+.+$",
]
CONVERSATION_PATTERNS = [
    r"^(hi|hello|hey|thanks|thank you|ok|okay|good|nice|cool|great|bye)$",
    r"^how\s+are\s+you.*$",
    r"^what(\s+is|\s*'s)\s+your\s+name.*$",
    r"\b(how do you|how you doing|how is it going)\b",
    r"\b(nice to meet you|pleasure to meet you)\b",
    r"\b(what do you think|your opinion|you like|you enjoy)\b",
    r"\b(thanks|thank you|appreciate it)\b",
    r"\b(goodbye|bye|see you|talk to you later)\b",
]
QUESTION_STARTS = ["what", "how", "why", "when", "where", "which", "explain", "describe", "tell me about"]
DOCUMENT_KEYWORDS = [
    "class", "method", "function", "object", "system", "component", "documentation",
    "code", "api", "interface", "library", "module", "framework",
]


def _first(rules: list[tuple[Column, object]], otherwise) -> Column:
    """First rule that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda acc, r: F.when(r[0], lit(r[1])).otherwise(acc), reversed(rules), lit(otherwise))


def _pattern_rules(q: Column) -> tuple[list, list]:
    low = F.lower(q)
    starts = tx.starts_with_any(low, QUESTION_STARTS)
    keyword = tx.contains_any(low, DOCUMENT_KEYWORDS)
    category = [
        (F.startswith(low, F.lit("find ")), SEARCH),
        (low.rlike(tx.any_of(SEARCH_PATTERNS)), SEARCH),
        (low.rlike(tx.any_of(CONCISE_PATTERNS)), CONCISE),
        (low.rlike(tx.any_of(CONVERSATION_PATTERNS)), CONVERSATION),
    ]
    confidence = [
        (category[0][0], 0.98),
        (low.rlike(tx.any_of(SEARCH_PATTERNS + CONCISE_PATTERNS + CONVERSATION_PATTERNS)), 0.95),
        (starts & keyword, 0.85),
        (starts | keyword, 0.7),
        (tx.word_count(q) >= 4, 0.6),
    ]
    return category, confidence


def pattern_category(q: Column) -> Column:
    return _first(_pattern_rules(q)[0], DOCUMENT)


def pattern_confidence(q: Column) -> Column:
    return _first(_pattern_rules(q)[1], 0.5)


# Greetings that never are document queries.
GREETING_PATTERNS = [
    r"^hi+\s*$", r"^hello+\s*$", r"^hey+\s*$", r"^thanks+\s*$",
    r"^thank you+\s*$", r"^ok+\s*$", r"^okay+\s*$", r"^good\s*$",
    r"^nice\s*$", r"^cool\s*$", r"^great\s*$", r"^bye+\s*$",
    r"^good morning\s*$", r"^good afternoon\s*$", r"^good evening\s*$",
    r"^how are you.*$", r"^how('s|\s+is) it going.*$", r"^how('s|\s+are) you doing.*$",
    r"^what('s|\s+is) up.*$", r"^sup+\s*$", r"^yo+\s*$", r"^wassup+\s*$",
    r"^what are you.*$", r"^who are you.*$", r"^tell me about yourself.*$",
]
# Keywords that make a query of one or two words a document query.
SHORT_QUERY_KEYWORDS = [
    "doc", "file", "class", "method", "function", "code",
    "object", "system", "wrapper", "component",
]
# Small talk inside a query.
SMALL_TALK_PATTERNS = [
    r"\b(how are you|how do you|how you doing|how is it going)\b",
    r"\b(your name|who are you|tell me about yourself)\b",
    r"\b(nice to meet you|pleasure to meet you)\b",
    r"\b(what do you think|your opinion|you like|you enjoy)\b",
    r"\b(weather|time is it|date today|current time)\b",
    r"\b(good morning|good evening|good afternoon|good night)\b",
]
# Question words.
QUESTION_WORDS = [
    "what", "how", "why", "when", "where", "which", "who",
    "explain", "describe", "tell me about", "show me", "what is", "what are",
]
# Topic keywords.
TOPIC_KEYWORDS = [
    "object", "wrapper", "system", "class", "java", "code",
    "document", "file", "interface", "method", "function",
    "application", "software", "program", "module", "component",
    "architecture", "pattern", "design", "structure", "data",
    "algorithm", "implementation", "api", "library", "framework",
    "repository", "project", "source", "test", "example",
    "feature", "integration", "service", "build", "deploy",
    "config", "settings", "option", "parameter", "variable",
    "database", "storage", "memory", "cache", "file", "format",
    "access", "security", "validation", "process", "thread", "query",
]
# Document words.
DOCUMENT_PATTERNS = [
    r"\b(doc|document)(s|\w*)\b",
    r"\b(code|coding|coded)\b",
    r"\b(class|classes)\b",
    r"\b(function|method|procedure)\b",
    r"\b(implement|implementation)\b",
    r"\b(api|interface|library)\b",
    r"\b(system|framework|architecture)\b",
    r"\b(object|instance|wrapper)\b",
    r"\b(explain|describe|detail|summary)\b",
    r"\b(definition|example|sample)\b",
    r"\b(error|issue|problem|bug)\b",
    r"\b(syntax|structure|format)\b",
    r"\b(tool|utility|component)\b",
    r"\b(file|directory|folder)\b",
    r"\b(pattern|design)\b",
    r"\b(build|compile|run)\b",
    r"\b(test|debug|fix)\b",
]


def is_document_query(q: Column) -> Column:
    """Whether a query most likely asks for document content."""
    low, n = F.lower(q), tx.word_count(q)
    return _first(
        [
            (low.rlike(tx.any_of(GREETING_PATTERNS)), False),
            ((n < 3) & ~tx.contains_any(low, SHORT_QUERY_KEYWORDS), False),
            (tx.starts_with_any(low, ["find ", "search "]), True),
            (F.contains(low, F.lit("?")), True),
            (low.rlike(tx.any_of(SMALL_TALK_PATTERNS)), False),
            (tx.starts_with_any(low, QUESTION_WORDS), True),
            (n >= 5, True),
            (tx.contains_any(low, QUESTION_WORDS + TOPIC_KEYWORDS), True),
            (low.rlike(tx.any_of(DOCUMENT_PATTERNS)), True),
            (n >= 3, True),
        ],
        False,
    )


# Openings that ask for brevity, beside the concise patterns above.
BREVITY_PATTERNS = [
    r".+\s+(keep\s+it|make\s+it)\s+(short|brief|concise|simple).*$",
    r"^concise[:]?\s+.+$",
    r"^brief[:]?\s+.+$",
    r"^short[:]?\s+.+$",
    r"^simple[:]?\s+.+$",
    r"^tldr[:]?\s+.+$",
]
# Courtesies, beside the small talk above.
COURTESY_PATTERNS = [
    r"\b(hello|hi there|hey|greetings)\b",
    r"\b(thanks|thank you|appreciate it)\b",
]
# Fixed value: a question short enough for a small model to answer briefly.
SHORT_QUESTION = r"^(what|how|why|when|where|which|who)\s+.{0,30}$"
ONE_SHORT_LINE = r"^.{0,50}$"


def categorize(q: Column, model_size: str) -> Column:
    """Rule chain that depends on the model: small models prefer short answers."""
    q = tx.strip(q)
    low, n = F.lower(q), tx.word_count(q)
    small = model_size == "small"
    chat = low.rlike(tx.any_of(SMALL_TALK_PATTERNS + COURTESY_PATTERNS))
    terse = (n <= 2) & ~F.contains(q, F.lit("?"))
    rules = [(F.startswith(low, F.lit("find ")), SEARCH)]
    if small:
        rules.append((low.rlike(tx.any_of([ONE_SHORT_LINE, SHORT_QUESTION])), CONCISE))
    rules += [
        (low.rlike(tx.any_of(CONCISE_PATTERNS + BREVITY_PATTERNS)), CONCISE),
        # scores .9 and .7 against the thresholds .4 (small) and .7 (large, exclusive)
        (chat | terse if small else chat, CONVERSATION),
        (~is_document_query(q), CONVERSATION),
    ]
    if small:
        rules.append((n < 8, CONCISE))
    return _first(rules, DOCUMENT)


def search_argument(q: Column) -> Column:
    """The query without its ``find`` prefix."""
    q = tx.strip(q)
    return F.when(F.startswith(F.lower(q), F.lit("find ")), F.substring(q, 6, 1 << 30)).otherwise(q)


# Keyword lists of the fallback classifier.
TINY_GREETINGS = ["hi", "hey", "hello", "k", "ok", "bye"]
SEARCH_KEYWORDS = ["search", "find", "locate", "list", "show me"]
CONCISE_KEYWORDS = ["brief", "summarize", "summarise", "short", "concise", "quick", "in a sentence"]
CONVERSATION_KEYWORDS = [
    "hi", "hello", "hey", "greetings", "howdy", "what's up", "good morning", "good afternoon", "good evening",
]


def is_tiny_talk(q: Column) -> Column:
    q = tx.strip(q)
    return (F.length(q) <= 3) | F.lower(q).isin(TINY_GREETINGS)


def keyword_category(q: Column) -> Column:
    low, n = F.lower(q), tx.word_count(q)
    return _first(
        [
            (is_tiny_talk(q) | low.isin(CONVERSATION_KEYWORDS) | (n < 3), CONVERSATION),
            (tx.contains_any(low, SEARCH_KEYWORDS), SEARCH),
            (tx.contains_any(low, CONCISE_KEYWORDS), CONCISE),
            ((n < 5) | F.endswith(q, F.lit("?")) | F.contains(low, F.lit("you")), CONVERSATION),
        ],
        DOCUMENT,
    )


# Words of the request-time fallback rule.
FALLBACK_CONCISE = ["summarize", "brief", "short", "tldr", "concise"]


def fallback_category(q: Column) -> Column:
    """Rule used where no classifier is configured."""
    low = F.lower(q)
    return _first(
        [
            (F.startswith(low, F.lit("find ")), SEARCH),
            (tx.word_count(q) < 4, CONVERSATION),
            (tx.contains_any(low, FALLBACK_CONCISE), CONCISE),
        ],
        DOCUMENT,
    )


# Technical terms.
TECHNICAL_TERMS = [
    "implementation", "architecture", "framework", "protocol",
    "algorithm", "methodology", "infrastructure", "configuration",
    "optimization", "integration", "deployment", "authentication",
]


def complexity(q: Column) -> Column:
    n, technical = tx.word_count(q), tx.contains_any(F.lower(q), TECHNICAL_TERMS)
    return _first([((n < 5) & ~technical, "simple"), ((n < 12) | ~technical, "moderate")], "complex")


# Wording of generated category descriptions.
FIND_WORDS = ["find", "search", "locate", "where"]
BRIEF_WORDS = ["summarize", "brief", "concise", "short", "tldr"]
ASK_WORDS = ["how", "what", "why", "when", "explain", "describe"]


def description_of(q: Column) -> Column:
    """Description of the kind of query ``q`` is."""
    low, n = F.lower(q), tx.word_count(q)
    topic = F.array_join(F.slice(tx.words(q), F.lit(2), F.greatest(n - 1, F.lit(0))), " ")
    bare = low
    for w in BRIEF_WORDS:
        bare = F.replace(bare, F.lit(w), F.lit(""))
    return _first(
        [
            (n <= 3, F.concat(F.lit("Queries like '"), q, F.lit("'"))),
            (tx.starts_with_any(low, FIND_WORDS),
             F.concat(F.lit("Requests to find or locate information about "), topic)),
            (tx.contains_any(low, BRIEF_WORDS),
             F.concat(F.lit("Requests for brief or summarized information about "), tx.strip(bare))),
            (tx.starts_with_any(low, ASK_WORDS),
             F.concat(F.lit("Questions seeking information about "), topic)),
        ],
        F.concat(F.lit("Conversational queries similar to '"), q, F.lit("'")),
    )


# Words ignored when queries are compared.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been",
    "being", "and", "or", "but", "if", "then", "else", "when",
    "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now",
    "what", "where", "which", "who", "whom", "this", "that", "these",
    "those", "i", "me", "my", "myself", "we", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "to", "from", "of",
]


def content_words(q: Column) -> Column:
    """Distinct query tokens without stopwords."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    return F.array_except(F.array_distinct(tx.tokens(q)), stop)


# Seed descriptions per category, to be embedded for zero-shot use.
SEED_DESCRIPTIONS = {
    CONVERSATION: [
        "General conversation, chitchat, greetings, or casual interaction with the system",
        "Personal questions about the system or casual dialogue not related to documents",
        "Greetings, thanks, acknowledgments, or personal questions about capabilities",
        "Small talk, pleasantries, or questions about opinions and preferences",
    ],
    DOCUMENT: [
        "Questions about specific information contained in documents",
        "Requests for explanations or details about topics covered in documentation",
        "Questions seeking to understand concepts, systems, or components described in docs",
        "Queries asking how something works or what something means in the documentation",
    ],
    CONCISE: [
        "Requests for brief or summarized information from documents",
        "Queries explicitly asking for concise, short, or summarized responses",
        "Requests to explain something briefly or provide a quick overview",
        "Queries using terms like 'summarize', 'brief', 'short', 'tldr', or 'concise'",
    ],
    SEARCH: [
        "Explicit requests to find or locate specific information in documents",
        "Search-like queries asking where to find information on a topic",
        "Queries starting with 'find', 'search', 'locate', or 'where can I find'",
        "Requests to show or list documents related to a specific topic",
    ],
}

# Seed queries per category, to be embedded for nearest-example use.
SEED_EXAMPLES = {
    CONVERSATION: [
        "How are you?",
        "What's your name?",
        "Thanks for the help",
        "Hello there",
        "What can you do?",
        "Tell me about yourself",
        "Nice to meet you",
        "Do you enjoy working?",
        "What is your favorite color?",
        "Goodbye for now",
    ],
    DOCUMENT: [
        "How does the authentication system work?",
        "What is the purpose of the wrapper class?",
        "Explain the object hierarchy",
        "What features does the API support?",
        "How do I use the configuration module?",
        "What are the main components of the system?",
        "How is data stored in the application?",
        "Explain how error handling works",
        "What design patterns are used in the codebase?",
        "How does the logging system work?",
    ],
    CONCISE: [
        "Summarize how authentication works",
        "Give me a short explanation of the wrapper class",
        "Brief overview of the object hierarchy",
        "Explain the API features concisely",
        "Describe the configuration module briefly",
        "Short summary of the system architecture",
        "Key points about error handling",
        "One paragraph about logging system",
        "Concise explanation of design patterns used",
        "TL;DR of the data storage approach",
    ],
    SEARCH: [
        "Find documentation about authentication",
        "Search for wrapper class information",
        "Find all references to object hierarchy",
        "Locate API features documentation",
        "Find configuration examples",
        "Show me documents about error handling",
        "Find information about logging",
        "Search for design pattern examples",
        "Where can I find data storage documentation",
        "Locate examples of component usage",
    ],
}
