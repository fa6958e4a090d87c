"""Schemas of the relations. Every relation has ``rec_id``, the recording; times are seconds from its start."""

WORDS = "rec_id string, word_idx bigint, start double, end double, text string, probability double"
TURNS = "rec_id string, turn_idx bigint, start double, end double, speaker string"
REGIONS = "rec_id string, idx bigint, start double, end double"
SEGMENT_WORDS = "array<struct<start:double,end:double,text:string,probability:double>>"
SEGMENTS = f"rec_id string, seg_idx bigint, start double, end double, speaker string, text string, words {SEGMENT_WORDS}"
MANIFEST = "id string, wav string, num_speakers int, duration double, overlap_prob double, overlapped_seconds double, turns array<struct<start:double,end:double,speaker:string>>, text string"
FRAMES = "session string, seq bigint, sample_rate int, pcm binary, stop boolean"
TRANSCRIPT = f"segments array<struct<speaker:string,start:double,end:double,text:string,words:{SEGMENT_WORDS}>>"
REFERENCE = "turns array<struct<start:double,end:double,speaker:string>>"
