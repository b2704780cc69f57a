from keelson.streaming.score_stream import score_stream, stream_request_id

__all__ = ["score_stream", "stream_request_id"]
