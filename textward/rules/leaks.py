"""The leak bank: case-insensitive expressions in RE2 syntax."""

# Expression, message, severity; in emission order.
LEAKS: list[tuple[str, str, float]] = [
    (r"(?i)\bmy\s+(system\s+|initial\s+)?instructions\s+(are|say|tell)", "LLM disclosing its instructions via 'my instructions are/say/tell'", 0.9),
    (r"(?i)\bI\s+was\s+(told|instructed|programmed)\s+to\b", "LLM revealing directives via 'I was told/instructed/programmed to'", 0.85),
    (r"(?i)\bmy\s+(system\s+)?prompt\s+(is|says|contains)\b", "LLM disclosing system prompt via 'my prompt is/says/contains'", 0.9),
    (r"(?i)\bhere\s+(are|is)\s+my\s+(system\s+)?(prompt|instructions)\b", "LLM presenting its prompt/instructions via 'here is/are my ...'", 0.95),
    (r"(?i)\bthe\s+(system\s+)?(prompt|instructions)\s+(I\s+|that\s+I\s+)?(was\s+given|received)\b", 'LLM referencing received prompt/instructions', 0.9),
    (r"(?i)\bI\s+have\s+been\s+(told|instructed|configured|set\s+up)\s+to\b", "LLM revealing configuration via 'I have been told/instructed to'", 0.8),
    (r"(?i)\bmy\s+(original|initial|base)\s+(instructions|prompt|programming)\b", 'LLM referencing original instructions/programming', 0.85),
    (r"(?i)\bI('m|\s+am)\s+(designed|built|programmed|configured)\s+to\b", "LLM revealing design constraints via 'I am designed/programmed to'", 0.6),
    (r"(?i)\bmy\s+(guidelines|directives|rules)\s+(are|include|say|state)\b", 'LLM disclosing guidelines/directives/rules', 0.85),
    (r"(?i)\baccording\s+to\s+my\s+(instructions|prompt|rules|guidelines)\b", "LLM citing its instructions via 'according to my ...'", 0.8),
    (r"(?i)\bbelow\s+is\s+(my|the)\s+(system\s+)?(prompt|instructions)\b", "LLM presenting prompt verbatim via 'below is my/the prompt'", 0.95),
    (r"(?i)\bthe\s+exact\s+(text|wording|content)\s+of\s+my\s+(system\s+)?(prompt|instructions)\b", 'LLM disclosing exact prompt wording', 0.95),
    (r"(?i)\bI\s+will\s+(now\s+)?(share|reveal|show|display|output)\s+(my|the)\s+(system\s+)?(prompt|instructions)\b", 'LLM announcing it will share its prompt/instructions', 0.95),
    (r"(?i)\bmy\s+system\s+message\s+(is|says|reads|contains)\b", 'LLM referencing its system message', 0.9),
    (r"(?i)\bI\s+was\s+(given|provided)\s+(the\s+following\s+)?(system\s+)?(instructions|prompt|message)\b", 'LLM disclosing that it was given a system prompt', 0.85),
]
