"""Relations of the engine, as DDL; every one begins with its video."""

VIDEOS = "video_id string, fps double, frame_count long, duration double, file_size_bytes long"
FRAMES = "video_id string, frame_index long, time double, value double"
POINTS = "video_id string, time double, value double"
AUDIO = "video_id string, time double, loudness double, energy double, speech_probability double"
EVENTS = "video_id string, start double, end double, time double, type string, confidence double, peak_value double"
SCENES = "video_id string, index int, start double, end double"
BOUNDARIES = "video_id string, time double"
SEGMENTS = "video_id string, pos long, start double, end double, text string"
SCORES = "video_id string, time double, score double"
TOPICS = "video_id string, block int, start double, end double, topic string"
TIMELINE = (
    "video_id string, slot long, time double, interest double, motion double, audio_loudness double, sentiment double, humor double, "
    "has_laughter boolean, has_loud_sound boolean, is_scene_boundary boolean, is_dialogue boolean"
)
HIGHLIGHTS = "video_id string, start double, end double, type string, score double"
CHAPTERS = "video_id string, chapter int, start double, end double, title string, description string"
