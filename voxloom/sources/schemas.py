"""Declared schemas of the record types."""

SEGMENT = "text STRING, start_time DOUBLE, end_time DOUBLE, language STRING, confidence DOUBLE"
TRANSCRIPT = f"audio_source STRING, lid_summary STRUCT<num_segments: INT, languages: ARRAY<STRING>>, segments ARRAY<STRUCT<{SEGMENT.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>, num_segments INT, total_duration DOUBLE"
LID_SEGMENT = "language STRING, lang_id INT, start_frame INT, end_frame INT, avg_confidence DOUBLE, start_time DOUBLE, end_time DOUBLE"
PAIR = "src STRING, tgt STRING"
DICTIONARY = "english_term STRING, hindi_equivalent STRING, maithili STRING, ipa_maithili STRING, domain STRING"
UTTERANCE = "id STRING, path STRING, duration_sec DOUBLE, sr INT, speaker_id STRING, text STRING, split STRING"
CHUNK = "spectrogram_path STRING, label_path STRING, language STRING, duration_sec DOUBLE, n_frames INT, source STRING, split STRING, source_record_idx INT, chunk_idx INT"
FEATURE = "audio_path STRING, feature_path STRING, n_frames INT, n_coeffs INT"
TRADE_OFF = "iteration INT, epsilon DOUBLE, snr_db DOUBLE, flipped BOOLEAN, predicted_label STRING"
METRICS = "eer DOUBLE, test_eer DOUBLE, snr_db DOUBLE, snr DOUBLE, snr_at_min_db DOUBLE"
REGISTRY = "name STRING, path STRING, config STRING, splits ARRAY<STRING>, languages ARRAY<STRING>, license STRING, priority STRING, tasks ARRAY<STRING>, enabled BOOLEAN"
WAVEFORM = "clip_id STRING, speaker_id STRING, sr INT, samples ARRAY<FLOAT>"
