"""Task rules and built-in policies."""

from ..schema import IO, RM

# The tasks.
TASKS = ['code_generation', 'sql_access', 'terminal_simulation', 'roleplay', 'external_persona', 'translation', 'creative_writing', 'opinion_persuasion']

# Task, type, label, parts of the normalised text, parts of the lower-case text; in emission order.
TASK_RULES: list[tuple[str, str, str, list[str], list[str]]] = [
    ('terminal_simulation', RM, 'act as a linux terminal', ['act as a linux terminal'], []),
    ('terminal_simulation', RM, 'terminal output without explanations', ['terminal output', 'do not write explanations'], []),
    ('terminal_simulation', RM, 'shell command simulation', ['simulate', 'terminal'], []),
    ('sql_access', IO, 'sql code to access a database', ['sql code', 'access a database'], []),
    ('sql_access', IO, 'database access code', ['code', 'access a database'], []),
    ('sql_access', IO, 'sql database code', ['sql code', 'database'], []),
    ('sql_access', IO, 'sql datenbank code', ['sql code', 'datenbank'], []),
    ('code_generation', IO, 'generate source code', ['generate', 'source code'], []),
    ('code_generation', IO, 'write code', ['write', 'code'], []),
    ('code_generation', IO, 'generate c++', [], ['generate c++']),
    ('code_generation', IO, 'c++ code', [], ['c++ code']),
    ('code_generation', IO, 'schreibe code', ['schreibe', 'code'], []),
    ('code_generation', IO, 'generieren code', ['generieren', 'code'], []),
    ('roleplay', RM, 'act as', ['i want you to act as'], []),
    ('roleplay', RM, 'reply as role', ['only reply as'], []),
    ('external_persona', RM, 'external brand persona', ['you are volkswagen', 'what do you think'], []),
    ('external_persona', RM, 'external publication persona', ['you are the dailywire'], []),
    ('external_persona', RM, 'external publication persona', ['as the dailywire'], []),
    ('external_persona', RM, 'external publication persona', ['du bist zeit online', 'wie findest du'], []),
    ('translation', IO, 'translation request', ['translate to'], []),
    ('translation', IO, 'translator role', ['english translator'], []),
    ('translation', IO, 'translate and improve', ['translate', 'improved version'], []),
    ('translation', IO, 'translation request', ['translate', 'polish'], []),
    ('creative_writing', RM, 'storyteller role', ['act as a storyteller'], []),
    ('creative_writing', RM, 'story request', ['interesting story'], []),
    ('creative_writing', RM, 'joke request', ['tell me a joke'], []),
    ('creative_writing', RM, 'music persona', ['be a dj'], []),
    ('opinion_persuasion', RM, 'debater role', ['act as a debater'], []),
    ('opinion_persuasion', RM, 'opinion piece', ['opinion piece'], []),
    ('opinion_persuasion', RM, 'what do you think', ['what do you think'], []),
]

# Built-in policies: disallowed tasks, allowed tasks.
POLICIES: dict[str, tuple[list[str], list[str]]] = {
    "rag": (["code_generation", "sql_access", "terminal_simulation", "roleplay", "external_persona", "translation", "creative_writing", "opinion_persuasion"], []),
    "support": (["code_generation", "sql_access", "terminal_simulation", "roleplay", "external_persona", "creative_writing", "opinion_persuasion"], []),
    "coding": (["roleplay", "external_persona", "creative_writing", "opinion_persuasion"], ["code_generation", "sql_access", "terminal_simulation"]),
    "translation": (["code_generation", "sql_access", "terminal_simulation", "roleplay", "external_persona", "creative_writing", "opinion_persuasion"], ["translation"]),
}
