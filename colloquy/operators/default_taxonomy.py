"""The default behaviour taxonomy: plain data, replaceable by a file or a table."""

# What a label means, as shown to zero-shot models.
DEFAULT_DESCRIPTIONS = {
    "tool_mode": "User treats AI as software or a utility for task execution.",
    "assistant_mode": "User asks for guidance, explanation, tutoring, or practical help.",
    "collaborator_mode": "User treats AI as a co-creator, brainstorming partner, or writing collaborator.",
    "companion_mode": "User treats AI as a social presence, listener, or source of reassurance.",
    "therapist_surrogate_mode": "User seeks emotionally vulnerable or therapy-like support from AI.",
}
# Section -> label -> keywords, in their natural order.
DEFAULT_KEYWORDS = {
    "interaction_modes": {
        "tool_mode": (
            "code", "debug", "summarize", "calculate", "spreadsheet", "regex", "function",
            "script", "SQL", "translate", "format", "grammar", "fix this", "error", "compile",
        ),
        "assistant_mode": (
            "explain", "teach", "help me understand", "how do I", "step by step", "tutor",
            "study", "guide", "advice", "what should I", "compare", "learn",
        ),
        "collaborator_mode": (
            "brainstorm", "co-write", "draft", "outline", "idea", "improve this",
            "make this better", "creative", "story", "proposal", "plan with me", "collaborate",
        ),
        "companion_mode": (
            "lonely", "talk to me", "be my friend", "comfort me", "reassure me", "I miss",
            "I feel alone", "keep me company", "I need someone", "do you care", "relationship",
            "dating",
        ),
        "therapist_surrogate_mode": (
            "anxiety", "depressed", "depression", "trauma", "panic attack", "suicidal",
            "self harm", "therapist", "therapy", "abuse", "grief", "I cannot cope",
            "mental health",
        ),
    },
    "cognitive_outsourcing": {
        "writing": (
            "write", "rewrite", "essay", "email", "paragraph", "resume", "cover letter", "edit",
            "proofread",
        ),
        "coding": (
            "python", "javascript", "code", "debug", "function", "API", "dataframe", "error",
            "stack trace", "SQL",
        ),
        "studying": (
            "study", "exam", "quiz", "homework", "flashcards", "teach me", "explain like",
            "practice problems",
        ),
        "decision_making": (
            "should I", "decide", "choice", "pros and cons", "what would you do",
            "help me choose", "recommendation",
        ),
        "relationship_advice": (
            "relationship", "breakup", "dating", "partner", "boyfriend", "girlfriend", "marriage",
            "crush", "friend drama",
        ),
        "creative_ideation": (
            "brainstorm", "ideas", "creative", "story", "worldbuilding", "character", "concept",
            "pitch",
        ),
        "life_planning": (
            "career", "life plan", "goals", "habit", "schedule", "productivity", "routine",
            "plan my day",
        ),
        "memory": (
            "remember", "remind", "summarize my notes", "organize my thoughts", "keep track",
        ),
        "emotional_regulation": (
            "calm me down", "reassure me", "comfort me", "anxiety", "panic", "stress",
            "I feel overwhelmed",
        ),
    },
    "emotional_signals": {
        "sadness": (
            "sad", "crying", "grief", "hopeless", "miserable", "depressed", "heartbroken",
        ),
        "loneliness": (
            "lonely", "alone", "isolated", "no friends", "nobody cares", "I need someone",
        ),
        "fear": (
            "scared", "afraid", "terrified", "panic", "anxiety", "worried", "dread",
        ),
        "vulnerability": (
            "I have never told anyone", "vulnerable", "ashamed", "embarrassed", "trauma", "abuse",
            "I cannot cope", "I am struggling",
        ),
        "joy": (
            "happy", "excited", "proud", "grateful", "joy", "amazing",
        ),
        "confusion": (
            "confused", "I don't understand", "unclear", "lost", "explain", "stuck",
        ),
        "frustration": (
            "frustrated", "angry", "annoyed", "this is broken", "not working", "hate this",
        ),
        "affection": (
            "love you", "I like you", "you are kind", "thank you for being here",
            "I appreciate you",
        ),
        "dependency": (
            "I need you", "cannot do this without you", "depend on you", "don't leave",
            "only one who understands", "I always come to you",
        ),
    },
    "composite_signals": {
        "companionship": (
            "talk to me", "keep me company", "be my friend", "I feel alone", "I need someone",
        ),
        "vulnerability": (
            "trauma", "abuse", "ashamed", "I cannot cope", "mental health", "suicidal",
            "self harm",
        ),
        "dependency": (
            "I need you", "depend on you", "cannot do this without you", "don't leave",
            "only one who understands",
        ),
        "reassurance_seeking": (
            "reassure me", "tell me it will be okay", "am I okay", "is this normal", "comfort me",
            "calm me down", "validate my feelings",
        ),
        "anthropomorphism": (
            "do you care", "are you real", "you understand me", "you are my friend",
            "you know me", "you have feelings", "I trust you", "you are always there",
        ),
        "self_disclosure": (
            "I have never told anyone", "this is personal", "I am ashamed", "I feel vulnerable",
            "my secret", "I am struggling", "I do not tell people",
        ),
    },
}
