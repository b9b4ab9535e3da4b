"""Fixed values.

Everything in this module is a value that has to be exactly what the
original toolchain uses for results to agree: prompt templates, system
prompts, markers, placeholders and tokens.  They are stated as plain text,
in their natural order, and nothing else lives here.
"""

# --- fixed values: characters that Python's ``str.strip()`` removes -------
# (tab, line feed, vertical tab, form feed, carriage return, the four
# information separators, space, next line, no-break space, ogham space
# mark, en quad .. hair space, line separator, paragraph separator, narrow
# no-break space, medium mathematical space, ideographic space)
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: generated-code cleanup -----------------------------------
END_OF_TEXT = "<|endoftext|>"
SCALA_FENCE_OPEN = "```scala"
FENCE = "```"
SCALA_NEWLINE = "scala\n"
RESPONSE_MARKER = "### Response:"
HUMAN_PREFIX = "Human: "

# --- fixed values: transcript split (DOTALL + IGNORECASE, first match) ------
# (``\\s`` there is Python's, so the class is spelled out: PY_WHITESPACE)
TRANSCRIPT_PROMPT_PATTERN = r"user[{ws}]*\n\n(.*?)[{ws}]*assistant[{ws}]*\n\n".replace("{ws}", PY_WHITESPACE)
TRANSCRIPT_CODE_PATTERN = r"assistant[{ws}]*\n\n(.*)".replace("{ws}", PY_WHITESPACE)
PROMPT_NOT_FOUND = "Prompt not found."
CODE_NOT_FOUND = "Generated code not found."

# --- fixed values: verdict messages ------------------------------------------
NO_CODE_MESSAGE = "No code provided"
BUILD_FAILED_PREFIX = "Build failed: "
WRITTEN_MESSAGE = "Code written successfully"
UNKNOWN_ERROR = "Unknown error"

# --- fixed values: role names -------------------------------------------------
HUMAN = "human"
ASSISTANT = "assistant"
# ShareGPT / chat-template spellings that mean the same speaker.
ROLE_ALIASES = {"user": "human", "gpt": "assistant", "human": "human",
                "assistant": "assistant", "system": "system"}

# --- fixed values: word tokenizer for BLEU -------------------------------------
# The public Treebank-style word rules: (pattern, replacement), applied in this
# order, each to the whole text; then the text is cut at white space.  Patterns are
# Java's; a word character is a letter, a number or an underscore.  Rules that follow
# each other and cannot see each other's spaces are one pattern (the tests hold them to
# the rules one by one).  With ``needs``, a rule matches only in texts that hold one of these.
_W = r"[\p{L}\p{N}_]"
_S = f"[{PY_WHITESPACE}]"
#: Listed, as one table of bits: ranges and characters beyond Latin-1 are tested one after the other.
_ASCII_WORDS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_ "
#: The second of two colons or commas is not looked at again, as when each match takes the next character.
_COLONS = r"([:,])([:,])"
_COLON = r"[:,](?!\p{Nd})"
_WORDS_IN_TWO = rf"(can)(not)(?!{_W})|(gim)(me)(?!{_W})|(gon)(na)(?!{_W})|(got)(ta)(?!{_W})|(lem)(me)(?!{_W})|(wan)(na)(?={_S})"
_IN_TWO = " $1$3$5$7$9$11 $2$4$6$8$10$12 "
#: Of a text without ASCII quotes (``"``, ``'``, a backtick): quotes, punctuation, the final
#: period, brackets, dashes, and white space as a space.
PLAIN_RULE = (rf"(?=[^{_ASCII_WORDS}])"
              rf"(?:{_COLONS}|([«“‘„»”’;@#$%&?!*\]\[(){{}}<>]|{_COLON}|\.{{2,}}|--|(?<=[^.])\.(?=[\])}}>»”’ ]*+{_S}*+\z))|{_S})",
              " $1$3 $2")
#: Of its words, on the text with a space before and after it.
PLAIN_END_RULE = (rf"(?iu)(?=[cCgGlLwW])(?<!{_W})(?:{_WORDS_IN_TWO})", _IN_TWO)
#: Of other texts: quotes that open, punctuation, brackets, dashes, quotes that close (needs, pattern, replacement).
WORD_RULES = [
    ((), r"([«“‘„]|`+)", " $1 "),
    (('"',), r'\A"', "``"),
    (("``",), r"(``)", " $1 "),
    (('"', "''"), r"""([ (\[{<])("|'{2})""", "$1 `` "),
    (("'",), rf"'(?![mtsdnMTSDN\u017f])({_W})(?!{_W})", "' $1"),
    ((".",), rf"""([^.])(\.)([\])}}>"'»”’ ]*+){_S}*+\z""", "$1 $2 $3 "),
    ((), rf"{_COLONS}|([;@#$%&?!]|{_COLON}|\.{{2,}})", " $1$3 $2"),
    ((".",), rf"""([^.])(\.)([\])}}>"']*+){_S}*+\z""", "$1 $2$3 "),
    (("' ",), r"([^'])' ", "$1 ' "),
    ((), r"[*\]\[(){}<>»”’]|--", " $0 "),
]
#: Endings and contractions, on the text with a space before and after it.
WORD_END_RULES = [
    (("''",), r"''", " '' "),
    (('"',), r'"', " '' "),
    (("'",), r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (("'",), r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    ((), rf"(?iu)(?=[cCdDgGlLmMwW])(?<!{_W})(?:{_WORDS_IN_TWO}|(d)('ye)(?!{_W})|(more)('n)(?!{_W}))",
     " $1$3$5$7$9$11$13$15 $2$4$6$8$10$12$14$16 "),
    ((" 't", " 'T"), rf"(?iu) ('t)(is)(?!{_W})", " $1 $2 "),
    ((" 't", " 'T"), rf"(?iu) ('t)(was)(?!{_W})", " $1 $2 "),
]

# --- fixed values: scoring constants -------------------------------------------
BLEU_MAX_ORDER = 4
BLEU_SMOOTHING_K = 5.0
CHRF_CHAR_ORDER = 6
CHRF_BETA = 2.0
LOSS_SMOOTH_WINDOW = 5
TRIAL_RATE_WEIGHT = 0.7
TRIAL_BLEU_WEIGHT = 0.3

# --- fixed values: prompt-engineering system prompt and variation templates ---
BASE_SYSTEM_PROMPT = (
    "You are an expert code assistant specializing in Akka and Scala. Your "
    "responses must consist solely of syntactically correct, runnable Scala "
    "code—no explanations, comments, or markdown formatting are allowed."
)

# (name, template); ``{base_prompt}`` is replaced by the test prompt.
VARIATION_TEMPLATES = [
    ("Zero shot", "{base_prompt}"),
    ("Chain of Thought",
     "Let's design the Akka/Scala solution step by step:\n"
     "1. What message types and case classes do we need?\n"
     "2. How should we structure the actor hierarchy?\n"
     "3. What behaviors should each actor implement?\n"
     "4. How should we handle communication and supervision?\n"
     "\n"
     "Now implement: {base_prompt}"),
    ("Few-Shot Learning",
     "Here's an example of a basic Akka/Scala pattern:\n"
     "\n"
     "// Message Protocol\n"
     "sealed trait Message\n"
     "case class Request(data: String) extends Message\n"
     "case class Response(result: String) extends Message\n"
     "\n"
     "// Actor Implementation\n"
     "class ExampleActor extends Actor {\n"
     "  def receive: Receive = {\n"
     "    case Request(data) => \n"
     "      // Process request\n"
     "      sender() ! Response(s\"Processed $data\")\n"
     "    case _ => // Handle unknown messages\n"
     "  }\n"
     "}\n"
     "\n"
     "Based on this pattern, implement: {base_prompt}"),
    ("Tree of Thoughts",
     "Three Akka/Scala experts are designing a solution:\n"
     "\n"
     "Expert A (Protocol Design):\n"
     "Step 1: Define message hierarchy and types\n"
     "Step 2: Plan actor communication patterns\n"
     "\n"
     "Expert B (Actor Implementation):\n"
     "Step 1: Design actor behaviors and states\n"
     "Step 2: Implement message handling logic\n"
     "\n"
     "Expert C (System Architecture):\n"
     "Step 1: Plan actor hierarchy and supervision\n"
     "Step 2: Define system configuration and setup\n"
     "\n"
     "Synthesize their approaches and implement: {base_prompt}"),
    ("ReAct",
     "Task: {base_prompt}\n"
     "\n"
     "Thought 1: Message Protocol Design\n"
     "Action 1: Define messages and case classes\n"
     "Output 1: Message types defined\n"
     "\n"
     "Thought 2: Actor Implementation\n"
     "Action 2: Create actor class with behaviors\n"
     "Output 2: Actor implementation complete\n"
     "\n"
     "Thought 3: System Integration\n"
     "Action 3: Setup actor system and communication\n"
     "Output 3: Complete working implementation\n"
     "\n"
     "Final Implementation:"),
]
BASE_PLACEHOLDER = "{base_prompt}"

# --- fixed values: instruction (alpaca-style) training text -------------------
INSTRUCTION_SYSTEM_PROMPT = "RETURN ONLY VALID CODE"
INSTRUCTION_TEMPLATE = (
    "Below is an instruction that describes a task, paired with an input that "
    "provides further context. {system}\n"
    "\n"
    "### Instruction:\n"
    "{instruction}\n"
    "\n"
    "### Input:\n"
    "{input}\n"
    "\n"
    "### Response:\n"
    "{response}"
)

# --- fixed values: chat-template header markers -------------------------------
CHAT_HEADER_START = "<|start_header_id|>"
CHAT_HEADER_END = "<|end_header_id|>\n\n"
CHAT_TURN_END = "<|eot_id|>"
CHAT_BEGIN = "<|begin_of_text|>"

# --- fixed values: lines of the final report --------------------------------------
REPORT_TITLE = "# Evaluation Final Report"
REPORT_SUMMARY = "## Summary"
REPORT_TOTAL = "Total running code snippets: "
REPORT_VARIATIONS = "## Results by Variation Type"
REPORT_BLEU = "- Average BLEU Score: "
REPORT_RATE = "- Success Rate: "

# --- fixed values: short escapes in JSON strings, the backslash first -----------
JSON_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
