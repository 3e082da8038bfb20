"""Explicit schemas of a library's tables and of landed files; nothing is inferred."""

from __future__ import annotations

ENTRY = "id bigint, entry_type string, changed_at bigint, softmatch_checked_at bigint"
IMPORT_RUN = "id bigint, started_at bigint, status string, pid int"
ENTRY_SOURCE = (
    "source string, identifier string, entry_id bigint, release_date string, fetched_at bigint, gone_at bigint, duration_ms bigint, "
    "duration_ms_all string, track_extra string, release_type string, num_discs int, num_tracks int, primary_type string, run_id bigint"
)
ENTRY_ALIAS = "id bigint, source string, identifier string, name string, locale string, extra string, primary boolean, run_id bigint"
ENTRY_CHILD = "parent_source string, parent_identifier string, child_source string, child_identifier string, disc_no int, track_no int, run_id bigint"
PAIR_LINK = "a_source string, a_identifier string, b_source string, b_identifier string, asserted_source string, asserted_identifier string, via string, run_id bigint"
BARRIER_MEMBER = "group_id bigint, source string, identifier string, anchor string"
CONTRIBUTION = "id bigint, source string, identifier string, artist_source string, artist_identifier string, role string, main_artist boolean, extra string, run_id bigint"
ENTRY_RELATION = "entry_a bigint, entry_b bigint, kind string, confidence double, origin string, enabled boolean, extra string"
DEDUP_FEEDBACK = (
    "id bigint, entry_a bigint, entry_b bigint, judgment string, origin string, model_version string, probability double, candidate_channels string, "
    "features string, evidence string, note string, supersedes_id bigint, created_at bigint"
)
PLAY_EVENT = "id bigint, entry_id bigint, started_at bigint, listened_seconds double"
PLAY_REPORT = "play_id bigint, reporter string, listened_seconds double"
PLAY_EXPORT = "play_id bigint, target string, exported_seconds double"
SCROBBLE_SUBMISSION = "account string, play_id bigint, payload string, status string, attempts int, next_attempt_at bigint, last_error string"
PAIR_IMAGE = "source string, identifier string, url string, width int, height int, origin string, run_id bigint"
PAIR_PRIVACY = "source string, identifier string, provider string, manual string, checked_at bigint"
PLAYLIST = "id bigint, name string, created_at bigint, updated_at bigint"
PLAYLIST_ITEM = "id bigint, playlist_id bigint, source string, identifier string, title string, position int, added_at bigint"
MIRROR_URL = "id bigint, gid string, url_norm string"
VECTOR = "entry_id bigint, entry_type string, text string, model string, vector array<float>"

TABLES = {
    "entry": ENTRY,
    "import_run": IMPORT_RUN,
    "entry_source": ENTRY_SOURCE,
    "entry_alias": ENTRY_ALIAS,
    "entry_child": ENTRY_CHILD,
    "pair_link": PAIR_LINK,
    "barrier_member": BARRIER_MEMBER,
    "contribution": CONTRIBUTION,
    "entry_relation": ENTRY_RELATION,
    "dedup_feedback": DEDUP_FEEDBACK,
    "play_event": PLAY_EVENT,
    "play_report": PLAY_REPORT,
    "play_export": PLAY_EXPORT,
    "scrobble_submission": SCROBBLE_SUBMISSION,
    "pair_image": PAIR_IMAGE,
    "pair_privacy": PAIR_PRIVACY,
    "playlist": PLAYLIST,
    "playlist_item": PLAYLIST_ITEM,
    "mb_url": MIRROR_URL,
    "vector": VECTOR,
}
