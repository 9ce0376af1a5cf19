"""Table schemas, the lifecycle vocabulary and fixed defaults."""

from __future__ import annotations

RAW_CHANNEL = (
    "ref string, kind string, id long, access_hash long, username string, title string, broadcast boolean, avatar_url string, "
    "full_chat struct<participants_count: int, about: string>"
)
RAW_MESSAGE = (
    "channel_id long, id long, kind string, date timestamp_ntz, message string, views int, forwards int, replies struct<replies: int>, "
    "reactions struct<results: array<struct<count: int>>>, video_note boolean, seq long"
)
RECOMMENDATION = "src_id long, pos int, cand struct<id: long, kind: string, broadcast: boolean, username: string, title: string>"
CHANNELS = (
    "id long, username string, title string, description string, subscribers_count int, avatar_url string, status string, is_author_blog boolean, "
    "created_at timestamp, updated_at timestamp"
)
POSTS = (
    "id long, channel_id long, message_id long, content string, published_at timestamp, views int, comments_count int, shares_count int, reactions_count int, "
    "created_at timestamp, updated_at timestamp"
)
POSTS_WITH_SEQ = f"{POSTS}, seq long"
FAILED_POSTS = "post_id long, channel_id long, text string, error string"
POST_VECTORS = "post_id long, vector array<float>, channel_id long, text string"

# Lifecycle states (fixed values).
PENDING, PROCESSING, READY, PARSED, REJECTED = "pending", "processing", "ready_for_parsing", "parsed", "rejected"

# Longest values by column (fixed values).
MAX_LENGTHS = {"username": 255, "title": 255, "avatar_url": 512, "status": 50}

# Words that mark first-person writing (fixed values).
FIRST_PERSON = ("я", "мне", "меня", "мое", "мой", "моя", "думаю", "считаю")

POSTS_PER_CHANNEL, MESSAGES_INSPECTED, PRONOUNS_NEEDED, MIN_SUBSCRIBERS, VECTOR_BATCH, DIMENSION = 10, 15, 3, 3000, 100, 384
