"""Readers and writers of recordings, subtitles, reports and ground truth."""
