"""Texts, patterns and word lists that results depend on."""

# Question styles, one template each.
QUESTION_STYLES = {
    "formal": "What is {ask}?",
    "colloquial": "Can you get me {ask}?",
    "imperative": "Return {ask}.",
    "interrogative": "Which {ask}?",
    "descriptive": "I need the following: {ask}.",
    "vague": "Pull details about {ask}.",
    "metaphorical": "Fish out the info about {ask}.",
    "conversational": "Hey, could you tell me {ask}?",
}

# Distractor phrases appended to questions.
DISTRACTORS = [
    "that went viral on TikTok",
    "with a sprinkle of magic",
    "who recently trended on social",
    "that broke the internet",
]

# Prompt that asks a model to rate a table.
RICHNESS_PROMPT = """Consider the following table header and sample rows.
Header: {header}
Samples:
{samples}

Score the semantic richness on a 0-1 scale (float). Lower for enumerations, IDs, code-only;
higher for concept-rich, relational data. Return only a number.
"""

# Prompt that asks a model for questions to a query.
QUESTION_PROMPT = """Given the database context and an SQL query, write {num} paraphrased natural-language questions
covering styles: {styles}. Include subtle distractor phrases in some variations.

Database: {db_id}
Table: {table}
Columns: {columns}
SQL: {sql}

Output one question per line.
"""

# Prompts that ask a model to rewrite a question and its query, by kind.
REWRITE_PROMPTS = {
    "semantic_rewrite": """Perform semantic rewriting: paraphrase the question and, when applicable, swap or reorder selected columns without changing results.
Produce {num} pairs.

DB: {db_id}
Table: {table}
Columns: {columns}
Original Q: {question}
Original A: {sql}

Output pairs as lines:
Q: ...\\nA: ...
""",
    "numeric_condition_transform": """Transform numeric conditions to equivalent ranges or thresholds (e.g., x>3 -> x BETWEEN 4 AND 9; adapt wording accordingly).
Ensure the rewritten SQL is equivalent or near-equivalent in intent for typical datasets. Produce {num} pairs.

DB: {db_id}
Table: {table}
Columns: {columns}
Original Q: {question}
Original A: {sql}

Output pairs as lines:
Q: ...\\nA: ...
""",
    "query_logic_adjustment": """Adjust queries like TOP-k DESC vs BOTTOM-k ASC by flipping order and wording consistently. Pick appropriate column(s) and keep semantics.
Produce {num} pairs.

DB: {db_id}
Table: {table}
Columns: {columns}
Original Q: {question}
Original A: {sql}

Output pairs as lines:
Q: ...\\nA: ...
""",
}

# System message of the text-to-SQL chat prompt.
CHAT_SYSTEM = "You are a text-to-SQL assistant. Return only the SQL query, no explanation."

# Keywords tried in this order when a model answer holds no fenced block.
SQL_START_WORDS = ["WITH", "SELECT", "INSERT", "UPDATE", "DELETE"]

# Aggregates and predicate forms counted in a query log.
AGGREGATE_NAMES = ["COUNT", "SUM", "AVG", "MIN", "MAX"]
PREDICATE_PATTERNS = {
    "Between": r"(?i)\bBETWEEN\b",
    "EQ": r"[^<>!=]=[^=]",
    "GT": r"[^<]>[^=]",
    "GTE": r">=",
    "In": r"(?i)\bIN\s*\(",
    "Is": r"(?i)\bIS\b",
    "LT": r"<[^=>]",
    "LTE": r"<=",
    "Like": r"(?i)\bLIKE\b",
    "NEQ": r"<>|!=",
    "Or": r"(?i)\bOR\b",
}

# Signs and words after which a double-quoted text is a value.
COMPARISONS = ["=", "==", "<>", "!=", "<", "<=", ">", ">=", "LIKE"]
# Words of a query that name nothing.
SQL_WORDS = [
    "SELECT", "DISTINCT", "ALL", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "LIMIT", "OFFSET",
    "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "ON", "USING", "AS", "WITH", "RECURSIVE",
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ESCAPE", "BETWEEN", "EXISTS", "TRUE", "FALSE",
    "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "UNION", "INTERSECT", "EXCEPT", "OVER", "PARTITION",
]

# Function words that tell four languages apart.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was",
           "on", "are", "by", "this", "be", "at", "from", "or"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "zu", "den", "mit",
           "von", "im", "auf", "für", "dem", "sich", "des", "auch", "als"],
    "fr": ["le", "la", "les", "et", "est", "des", "une", "un", "que", "dans", "qui", "pour",
           "du", "pas", "sur", "avec", "au", "ce", "il", "elle"],
    "es": ["el", "los", "las", "que", "y", "en", "un", "una", "por", "con", "para", "del",
           "se", "su", "al", "lo", "como", "más", "pero", "de"],
}

# Prefix of generated database ids; five digits follow.
DB_ID_PREFIX = "fusion_"
