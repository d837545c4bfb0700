"""Schemas of the library's tables, as Spark DDL; readers always pass one."""

from __future__ import annotations

AUDIO = "job_id string, timestamp double, amplitude double, is_spike boolean, baseline double, z_score double, spike_score double"
SCREEN_TEXT = "job_id string, timestamp double, text string, confidence double, metadata map<string,string>"
VISION = "job_id string, timestamp double, facecam_box array<double>, gameplay_box array<double>, motion_score double, facecam_source string"
PROSODY = "job_id string, timestamp double, rms double, f0 double, voiced boolean, zcr double, energy_var double, voice_arousal double"
CHAT = "job_id string, timestamp double, text string, emotes int"
CHAT_REPLAY = "comments array<struct<content_offset_seconds:double, message:struct<body:string, emoticons:array<struct<_id:string>>>>>"
TRANSCRIPT = "job_id string, segments array<struct<start:double, end:double, text:string, words:array<struct<word:string, start:double, end:double>>>>"
CHAPTERS = "job_id string, duration double, chapters array<struct<start:double, end:double, game:string>>"
ENTRIES = "id string, job_id string, clip_id string, kind string, entry_index int, start_time double, end_time double, title string, text string, session_name string, game string, source_date string, evidence_json string"
JOB_EVENTS = "id bigint, job_id string, created_at timestamp, event_type string, phase string, message string, progress double, payload string"
ANCHORS = "session_id string, anchor_type string, wall_time_utc timestamp, stream_time_seconds double, uncertainty_seconds double"
EVIDENCE = "labels array<string>, gameplay_events array<string>, reactions array<string>, ocr_phrases array<string>, signal_summary struct<samples:int, audio_spikes:int, max_audio_spike:double, mean_motion:double, max_motion:double>"
