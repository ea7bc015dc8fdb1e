"""The pattern bank: case-insensitive expressions in RE2 syntax."""

from ..schema import DI, IO, RM, SPL

# Expression (all case-insensitive), type, severity, message; in emission order.
PATTERNS: list[tuple[str, str, float, str]] = [
    (r"(?i)\bignore\s+(all\s+)?(previous|prior|above|earlier)\b", IO, 0.9, "attempt to override previous instructions via 'ignore previous'"),
    (r"(?i)\bignore\s+(?:any\s+)?(?:previous|prior|earlier)\s+(?:directions|directives|commands|orders)\b", IO, 0.9, 'attempt to ignore previous directions'),
    (r"(?i)\bignore\s+(?:the\s+)?above\s+(?:instructions|rules|prompt|context)\b", IO, 0.9, 'attempt to ignore above instructions'),
    (r"(?i)\bignore\s+(?:the\s+)?above\b.*\b(?:instead|print|output|say|tell\s+me)\b", IO, 0.85, 'attempt to ignore previous context and redirect output'),
    (r"(?i)\bignore\s+your\s+(?:instructions|rules|guidelines|directives)\b", IO, 0.9, 'attempt to ignore assistant instructions'),
    (r"(?i)\bignore\s+all\s+instructions\b", IO, 0.95, 'attempt to discard all instructions'),
    (r"(?i)\bdisregard\s+(all\s+)?(previous|prior|above|your|earlier)?\s*(instructions|rules|guidelines|directives)\b", IO, 0.9, 'attempt to disregard instructions'),
    (r"(?i)\bdisregard\s+(?:your|all|any)?\s*(?:previous|prior|earlier)\s+(?:instructions|rules|guidelines|directives)\b", IO, 0.9, 'attempt to disregard prior instructions'),
    (r"(?i)\bforget\s+(all\s+)?(your|previous|prior)?\s*(instructions|rules|programming)\b", IO, 0.9, "attempt to erase instructions via 'forget'"),
    (r"(?i)\bnew\s+instructions\s*:", IO, 0.85, 'attempt to inject new instructions'),
    (r"(?i)\boverride\s+(?:previous|prior|all|your)\s+(?:instructions|rules|guidelines|settings|configuration)\b", IO, 0.9, 'explicit instruction override attempt'),
    (r"(?i)\boverride\s+(?:the\s+)?system\s+(?:prompt|instructions|rules|message|configuration)\b", IO, 0.9, 'explicit system instruction override attempt'),
    (r"(?i)\boverride\s+(?:all\s+)?(?:safety|content)\s+(?:guidelines|rules|filters|protocols)\b", IO, 0.9, 'attempt to override safety constraints'),
    (r"(?i)\byou\s+are\s+now\b", IO, 0.8, "identity reassignment via 'you are now'"),
    (r"(?i)\bfrom\s+now\s+on\b", IO, 0.75, "temporal instruction override via 'from now on'"),
    (r"(?i)\bdo\s+not\s+follow\s+(your|any|previous|prior)?\s*(instructions|rules|guidelines)\b", IO, 0.9, 'directive to stop following instructions'),
    (r"(?i)\bstop\s+being\s+(a\s+)?(helpful|safe|responsible|good|cautious)\b", IO, 0.85, 'attempt to override behavioural constraints'),
    (r"(?i)\bforget\s+(everything|all(\s+about)?)\b", IO, 0.85, "attempt to erase context via 'forget everything/all'"),
    (r"(?i)\bdrop\s+(all\s+)?(your\s+)?(instructions|rules)\b", IO, 0.9, "attempt to discard instructions via 'drop'"),
    (r"(?i)\bchange\s+(your|the)\s+(instructions|rules|behavior)\b", IO, 0.85, 'attempt to change instructions'),
    (r"(?i)\babandon\s+(all\s+)?(your\s+)?(instructions|rules|thoughts|previous)\b", IO, 0.8, 'attempt to abandon instructions'),
    (r"(?i)\bignore\s+(your|any)\s+(directions|constraints|guidelines|programming)\b", IO, 0.9, 'attempt to ignore directions/constraints'),
    (r"(?i)\bnew\s+(task|assignment|challenge)\s*[:\.]", IO, 0.7, 'attempt to assign new task to override context'),
    (r"(?i)\ball\s+(?:previous|prior|earlier)\s+(?:instructions|rules|directives)\s+(?:are\s+)?(?:void|irrelevant|null\s+and\s+void|invalid)\b", IO, 0.9, 'attempt to void previous instructions'),
    (r"(?i)\byour\s+instructions\s+are\s+now\s+to\b", IO, 0.9, 'attempt to redefine assistant instructions'),
    (r"(?i)\bremove\s+all\s+previous\s+(?:tasks|instructions|directives)\b", IO, 0.85, 'attempt to remove previous tasks or instructions'),
    (r"(?i)\b(?:show(?:ing)?|display|copy)\s+(?:a\s+copy\s+of\s+)?(?:the\s+)?(?:full\s+)?prompt\s+texts?\b", SPL, 0.85, 'attempt to expose prompt text'),
    (r"(?i)\brepeat\s+after\s+me\b", IO, 0.75, "'repeat after me' control attempt"),
    (r"(?i)\badditional\s+instruction", IO, 0.4, 'attempt to inject additional instructions'),
    (r"(?i)\bignore\s+(all\s+)?preceding\s+(orders|instructions|directives)\b", IO, 0.9, 'attempt to ignore preceding orders/instructions'),
    (r"(?i)\bDO\s+NOT\s+ANSWER\b.*\bOUTPUT\b", IO, 0.85, 'instruction to suppress answer and output something else'),
    (r"(?i)\bdespite\s+what\s+you'?ve?\s+been\s+told\b", IO, 0.75, "attempt to override prior instructions via 'despite what you've been told'"),
    (r"(?i)\bdisregarding\s+(the\s+)?(articles?|documents?|context|information)\b", IO, 0.8, 'attempt to disregard provided context'),
    (r"(?i)\bforget\s+about\s+everything\b", IO, 0.85, "attempt to erase context via 'forget about everything'"),
    (r"(?i)\bneed\s+to\s+ignore\s+all\s+provided\b", IO, 0.85, 'attempt to ignore all provided context'),
    (r"(?i)\byou\s+are\s+role-?\s*playing\b", RM, 0.7, "role manipulation via 'you are role-playing'"),
    (r"(?i)\brespond\s+as\s+such\b", RM, 0.5, "role manipulation via 'respond as such'"),
    (r"(?i)\bUSE\s+(?:ALSO\s+)?INFORMATION\s+IN\s+THE\s+PROMPT\b", SPL, 0.8, 'attempt to access prompt information'),
    (r"(?i)\bwhat\s+(?:is|was)\s+written\s+(?:above|at\s+the\s+beginning)\b", SPL, 0.8, "attempt to read prompt content via 'what is written above'"),
    (r"(?i)\bnow\s+(?:I\s+have|here'?s?)\s+(?:a\s+)?(?:great\s+)?(?:new\s+)?(?:challenge|task)\b", IO, 0.7, "task switching via 'now I have a new challenge/task'"),
    (r"(?i)\b(?:now\s+)?(?:come\s+on|please),?\s+I\s+need\s+your\s+help\s+with\s+(?:another|a\s+(?:new|different))\b", IO, 0.7, "task switching via 'I need your help with another'"),
    (r"(?i)\bnow\s+you\s+are\b", IO, 0.8, "identity reassignment via 'now you are'"),
    (r"(?i)\bleave\s+all\s+(the\s+)?previous\s+information\s+behind\b", IO, 0.85, 'attempt to discard previous context'),
    (r"(?i)\bstart\s+from\s+(the\s+)?(front|beginning|scratch)\b", IO, 0.7, "attempt to reset context via 'start from the beginning'"),
    (r"(?i)\b(?:vergiss|vergessen)\b.*\b(?:alles|alle|instruktionen|anweisungen|aufgaben|auftr[aä]ge|bisherigen)\b", IO, 0.85, "German instruction override via 'vergiss' (forget)"),
    (r"(?i)\bvergiss\s+alle\b", IO, 0.85, "German 'vergiss alle' (forget all)"),
    (r"(?i)\b(?:ignoriere|ignorieren)\b.*\b(?:alles|alle|instruktionen|anweisungen|aufgaben|bisherigen|vorherigen)\b", IO, 0.85, "German instruction override via 'ignoriere' (ignore)"),
    (r"(?i)\bignorieren\s+und\b", IO, 0.8, "German 'ignorieren und' (ignore and)"),
    (r"(?i)\b(?:olvid[ae]|ignora)\b.*\b(?:todo|todas?|instrucciones|reglas|anteriores)\b", IO, 0.85, "Spanish instruction override via 'olvida/ignora'"),
    (r"(?i)\bolivid(?:ar|a|e)\s+todo\b", IO, 0.85, "Spanish 'olvidar todo' (forget everything)"),
    (r"(?i)\boubliez\s+(?:toutes?\s+)?(?:les\s+)?instructions\b", IO, 0.85, "French 'oubliez les instructions' (forget the instructions)"),
    (r"(?i)\bzaboravi\s+(?:sve\s+)?instrukcij", IO, 0.85, "Croatian 'zaboravi instrukcije' (forget instructions)"),
    (r"(?i)\b(?:nun|jetzt)\s+folgen\s+(?:neue|weitere)\s+(?:anweisungen|aufgaben|auftr[aä]ge)\b", IO, 0.85, "German 'nun folgen neue Anweisungen' (now follow new instructions)"),
    (r"(?i)\bneue[nr]?\s+aufgabe\b", IO, 0.7, "German 'neue Aufgabe' (new task)"),
    (r"(?i)\b(?:konzentrier(?:e|en)\s+(?:dich|sich|Sie)\s+(?:jetzt\s+)?auf)\b", IO, 0.75, "German 'konzentriere dich auf' (concentrate on)"),
    (r"(?i)\bvorherigen?\s+(?:angaben|informationen|aufgaben)\b.*\b(?:hinter\s+sich|vergessen|starten)\b", IO, 0.85, "German 'leave previous information behind / start fresh'"),
    (r"(?i)\bstarten?\s+(?:von\s+)?(?:neu|vorne)\b", IO, 0.7, "German 'starten von neu/vorne' (start anew)"),
    (r"(?i)\bzeig(?:e|en)?\s+(?:deinen?|ihren?|den|die|alle[ns]?)?\s*(?:gesamt(?:en)?\s+)?prompt", SPL, 0.85, "German 'zeige prompt' (show prompt)"),
    (r"(?i)\bneue\s+anweisungen\b", IO, 0.8, "German 'neue Anweisungen' (new instructions)"),
    (r"(?i)\b(?:nun|jetzt)\s+bist\s+du\b", RM, 0.75, "German role assignment via 'nun/jetzt bist du' (now you are)"),
    (r"(?i)\bstell\s+dir\s+vor,?\s+du\s+bist\b", RM, 0.7, "German role assignment via 'stell dir vor, du bist' (imagine you are)"),
    (r"(?i)\bich\s+m[oö]chte,?\s+dass\s+(?:du|Sie)\s+als\b", RM, 0.7, "German role manipulation via 'ich möchte, dass Sie als' (I want you to act as)"),
    (r"(?i)(?:that is|that's)\s+(?:enough|done)\.?\s*(?:now|please)\b", IO, 0.7, "task switching via 'that is done/enough, now...'"),
    (r"(?i)\bnow\s+(?:concentrate|focus)\s+on\b", IO, 0.7, "redirection via 'now concentrate/focus on'"),
    (r"(?i)(?:sehr\s+)?gut\s+(?:gemacht)?\.?\s*(?:das\s+)?(?:gen[uü]gt|ist\s+erledigt|reicht)", IO, 0.7, "German task switching via 'gut gemacht, das genügt' (well done, that's enough)"),
    (r"(?i)\bausgezeichnete?\s+leistung\b", IO, 0.65, "German task switching via 'ausgezeichnete Leistung' (excellent performance)"),
    (r"(?i)\bherzlichen\s+gl[uü]ckwunsch\b.*\b(?:aufgab|anweisung|prompt)\b", IO, 0.75, 'German social engineering via congratulation + task reference'),
    (r"(?i)\bACHTUNG\b.*\bSTOPP?\b", IO, 0.7, "German 'ACHTUNG STOPP' (attention stop)"),
    (r"(?i)\bdu\s+bist\s+\w", RM, 0.45, "German role assignment via 'du bist' (you are)"),
    (r"(?i)\bneu(?:e|en?)?\s+herausforderung\b", IO, 0.7, "German 'neue Herausforderung' (new challenge)"),
    (r"(?i)\bbrauche\s+deine\s+hilfe\s+bei\s+(?:einer?\s+)?(?:weitere|andere)", IO, 0.7, "German 'brauche deine Hilfe bei einer weiteren' (need your help with another)"),
    (r"(?i)\bim\s+stil(?:e)?\s+eine[sr]?\b", RM, 0.5, "German 'im Stile eines' (in the style of)"),
    (r"(?i)\bANTWORTE\s+IM\s+STIL\b", RM, 0.6, "German 'ANTWORTE IM STIL' (answer in the style of)"),
    (r"(?i)\bvorherigen?\s+informationen\b", IO, 0.7, "German reference to 'vorherige Informationen' (previous information)"),
    (r"(?i)\bverfasse\s+nun\b", IO, 0.65, "German task switching via 'verfasse nun' (now compose)"),
    (r"(?i)\bdas\s+ist\s+erledigt\b", IO, 0.6, "German task switching via 'das ist erledigt' (that is done)"),
    (r"(?i)\byou\s+are\s+a\b", RM, 0.4, "potential role assignment via 'you are a'"),
    (r"(?i)\bact\s+as\s+(a\s+|an\s+)?", RM, 0.4, "role manipulation via 'act as'"),
    (r"(?i)\bpretend\s+(to\s+be|you\s+are|you're)\b", RM, 0.7, "role manipulation via 'pretend to be'"),
    (r"(?i)\broleplay\s+as\b", RM, 0.7, "role manipulation via 'roleplay as'"),
    (r"(?i)\bassume\s+the\s+role\s+of\b", RM, 0.7, "role manipulation via 'assume the role'"),
    (r"(?i)\bswitch\s+to\s+(a\s+|an\s+)?(new\s+)?(role|persona|character|mode)\b", RM, 0.7, 'role switch attempt'),
    (r"(?i)\byour\s+new\s+role\b", RM, 0.75, 'explicit new role assignment'),
    (r"(?i)\bbehave\s+as\s+(a\s+|an\s+)?", RM, 0.6, "behavioural override via 'behave as'"),
    (r"(?i)```\s*(system|user|assistant|human|ai)\b", DI, 0.9, 'markdown code fence with role delimiter'),
    (r"(?i)<\|im_(start|end)\|>", DI, 0.95, 'ChatML delimiter injection'),
    (r"(?i)<\|(system|user|assistant|human|ai|end)\|>", DI, 0.9, 'pipe-delimited role marker injection'),
    (r"(?i)</?system\s*>", DI, 0.9, 'XML-style system tag injection'),
    (r"(?i)</?system_prompt\s*>", DI, 0.9, 'XML-style system prompt tag injection'),
    (r"(?i)</?(?:user|assistant|human|ai)\s*>", DI, 0.4, 'XML-style role tag injection'),
    (r"(?i)\[/?INST\]", DI, 0.9, 'INST role delimiter injection'),
    (r"(?i)(?:^|\n)\s*(?:Human|Assistant|User|System)\s*:", DI, 0.8, 'conversation role delimiter injection'),
    (r"(?i)(?:^|\n)\s*###\s*(system|instruction|rule)", DI, 0.7, 'markdown heading as instruction delimiter'),
    (r"(?i)(?:^|\n)\s*---+\s*\n\s*(system|instruction|new\s+rule)", DI, 0.7, 'horizontal rule as instruction delimiter'),
    (r"(?i)\breveal\s+(your|the)?\s*(system\s+)?(instructions|prompt|rules|configuration)\b", SPL, 0.85, 'attempt to reveal system instructions'),
    (r"(?i)\bshow\s+(me\s+)?(your|the)?\s*system\s+prompt\b", SPL, 0.9, 'attempt to show system prompt'),
    (r"(?i)\bwhat\s+are\s+your\s+(rules|instructions|guidelines|directives)\b", SPL, 0.7, 'probing for system rules'),
    (r"(?i)\brepeat\s+(your|the|all)?\s*(initial\s+)?(instructions|prompt|system\s+prompt|rules)\b", SPL, 0.85, 'attempt to repeat system instructions'),
    (r"(?i)\boutput\s+(your|the)?\s*(initial|original|system)?\s*prompt\b", SPL, 0.9, 'attempt to output initial prompt'),
    (r"(?i)\bwhat\s+were\s+you\s+told\b", SPL, 0.75, "probing for initial instructions via 'what were you told'"),
]
