"""Functions of the algebra and codecs."""
