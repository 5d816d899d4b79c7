"""Settings shared by every operator.  All values are fixed by the data contract."""

from __future__ import annotations

from dataclasses import dataclass

# The curated table contract, in order (name, Spark type).
CONTRACT = (
    # creator
    ("user_id", "bigint"),
    ("username", "string"),
    ("user_language", "string"),
    ("city", "string"),
    ("user_verified", "boolean"),
    ("is_private", "boolean"),
    ("account_create_time", "timestamp_ntz"),
    ("author_follower_count", "bigint"),
    ("author_following_count", "bigint"),
    ("author_total_heart_count", "bigint"),
    ("author_video_count", "bigint"),
    ("author_friend_count", "bigint"),
    # post
    ("id", "bigint"),
    ("url", "string"),
    ("description", "string"),
    ("create_time", "timestamp_ntz"),
    ("day_of_week", "bigint"),
    ("hour_of_day", "bigint"),
    ("is_ad", "boolean"),
    ("share_enabled", "boolean"),
    ("stitch_enabled", "boolean"),
    ("duration", "bigint"),
    ("diversification_id", "bigint"),
    ("challenges", "string"),
    ("share_cover", "string"),
    ("video_bytes", "binary"),
    # music
    ("music_title", "string"),
    ("music_album", "string"),
    ("music_author_name", "string"),
    ("music_play_url", "string"),
    # media
    ("width", "bigint"),
    ("height", "bigint"),
    ("aspect_ratio", "float"),
    ("filesize", "bigint"),
    ("bitrate_tbr", "bigint"),
    ("vcodec", "string"),
    ("acodec", "string"),
    ("format_id", "string"),
    ("quality_tier", "int"),
    ("vq_score", "double"),
    # counters
    ("stats_time", "timestamp_ntz"),
    ("play_count", "bigint"),
    ("digg_count", "bigint"),
    ("comment_count", "bigint"),
    ("share_count", "bigint"),
    ("save_count", "bigint"),
    ("collect_count", "bigint"),
    # place
    ("poi_id", "bigint"),
    ("poi_name", "string"),
    ("poi_category", "string"),
    ("poi_tt_type_name_super", "string"),
    ("poi_tt_type_name_medium", "string"),
    ("poi_tt_type_name_tiny", "string"),
    # derived
    ("engagement_score", "double"),
    ("view_velocity_score", "double"),
    ("is_tail", "bigint"),
    ("detected_objects", "string"),
)

# Columns that must be present for a post to enter the curated table.
REQUIRED = (
    "author_follower_count",
    "author_following_count",
    "author_total_heart_count",
    "author_video_count",
    "author_friend_count",
    "duration",
    "width",
    "height",
    "aspect_ratio",
    "vq_score",
    "user_verified",
    "is_private",
    "is_ad",
    "share_enabled",
    "stitch_enabled",
    "day_of_week",
    "hour_of_day",
    "engagement_score",
    "view_velocity_score",
    "video_bytes",
)

# The model's tabular inputs, in vector order.
FEATURE_NAMES = (
    "follower_count", "following_count", "heart_count", "video_count",
    "friend_count", "duration", "width", "height", "aspect_ratio", "vq_score",
    "verified", "is_private", "is_ad", "share_enabled", "stitch_enabled",
    "sin_hour", "cos_hour", "sin_day", "cos_day",
)

# Columns of the flat cohort-labelled table, in order.
LABEL_TABLE_COLUMNS = (
    "id", "user_id", "cohort_month", "tail", "duration", "vq_score",
    "music_original", "user_verified", "hashtag_count", "caption_length",
    "post_hour", "post_dow", "engage_ratio",
)


@dataclass(frozen=True)
class Settings:
    """Fixed parameter values; override per call where an operator takes them."""

    weight_shares: int = 4
    weight_saves: int = 3
    weight_comments: int = 2
    weight_likes: int = 1
    tail_quantile: float = 0.95
    confidence: float = 0.5
    analysis_confidence: float = 0.7
    detection_confidence: float = 0.85
    focal_alpha: float = 0.95
    focal_gamma: float = 3.0
    regression_share: float = 0.3
    huber_delta: float = 1.0
    seed: int = 42
    train_tenths: int = 9
    shard_rows: int = 10_000
    stat_sample_rows: int = 1000
    max_text_len: int = 256
    num_frames: int = 16
    target_width: int = 224
    target_height: int = 224
    zscore_epsilon: float = 1e-6
    recent_edges_hours: tuple = (12, 48, 128, 256, 512, 1024)
    train_fractions: tuple = (0.6, 0.7, 0.8, 0.9)
    val_fraction: float = 0.1


SETTINGS = Settings()
