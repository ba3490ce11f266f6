"""Photarium: media-catalogue analytics on Spark DataFrames."""
