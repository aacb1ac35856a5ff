"""Defaults of the operators: limits, thresholds, word lists and fixed messages."""

# Limits and thresholds.
CHUNK_WORDS, DIRECT_WORDS, CONTEXT_WORDS = 500, 700, 1300
QUESTION_CHARS, VIDEO_ID_CHARS, HISTORY = 1000, 20, 6
TOP_K, SIMILARITY, DIGITS = 3, 0.25, 4
CANDIDATES, QUESTIONS, MERGE_GAP, DEDUPE, GROUNDING = 60, 12, 2.0, 0.80, 0.5
SUMMARY_BATCH, VALIDATION_BATCH, EMBEDDING_BATCH = 16, 20, 32
SUMMARY_LINES, SUMMARY_VERSION, DIMENSION = 15, 3, 384
#: A model call: padded characters of a batch at most, and how many of them a call costs beside its rows.
BATCH_CHARS, CALL_CHARS = 96_000, 400
#: Tokens that a reply may have, by what is asked; those of a chunk's summary are in LENGTH_RULES.
FINAL_TOKENS, VALIDATION_TOKENS, ANSWER_TOKENS, REWRITE_TOKENS = 800, 40, 300, 60
#: Chunks of a video from which on a rule holds: (least chunks, token cap, wording).
LENGTH_RULES = (
    (8, 120, "2 to 3 sentences, below about 70 words"),
    (4, 160, "3 to 4 sentences, below about 100 words"),
    (0, 240, "5 to 6 sentences, below about 150 words"),
)

# Word lists.
INTERROGATIVES = "what why how when where who whom whose which can could should would will do does did is are was were has have had".split()
LEAD_INS = "so now but and then".split()
FILLER_OPENERS = "okay alright right so yeah now".split()
FILLERS = (
    "are you ready|are you there|are you following|are you with me|are you guys ready|can you hear me|can you see me|"
    "does that make sense|does this make sense|you know|right|okay|alright"
).split("|")
CONCEPTUAL = "what why how can could should would".split()
STOP_WORDS = (
    "the a an is are was were do does did what why how when where who which can could should would will to of in on for and or "
    "that this it its we you i he she they them us be been being have has had not so but if then there here with from at as by "
    "your my his her our their"
).split()
REFERRING = (
    "it its they them their theirs this that those these he she his her there one ones previous previously above earlier former "
    "latter same first second third last another else more"
).split()
FOLLOW_STARTS = "and but so also then".split()

# Hosts and messages.
WATCH_HOSTS, SHORT_HOST = ("youtube.com", "m.youtube.com", "music.youtube.com"), "youtu.be"
BAD_URL = "Please enter a valid YouTube video URL."
NO_SEGMENTS = "No usable transcript was found."
BAD_TRANSCRIPT = "Transcript processing failed."
EMPTY_QUESTION = "Please enter a question."
NOT_INDEXED = "This video hasn't been processed yet."
NO_ANSWER = "I couldn't find enough information about that in the video."
NOTHING_TO_SUMMARIZE = "There is no transcript content to summarize."
NO_SUMMARY = "We couldn't generate a summary for this video. Please try again."
READY, PROCESSING, FAILED = "ready", "processing", "failed"
