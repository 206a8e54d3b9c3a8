"""Production parameters of the mixes."""

from .mixing import Recipe

#: The registered query's: curated text over the web's, and English below its share of all text.
MIX = Recipe(domains={"web": 2, "curated": 3}, langs={"en": 4, "de": 3, "fr": 3, "es": 3}, sources={"src0": 3}, permille=600, epochs=2)
#: The pipeline's: nothing is taken twice, and nine tenths of all tokens are.
PIPELINE_MIX = Recipe(domains={"web": 1, "curated": 1}, langs={"en": 3, "de": 1, "fr": 1, "es": 1}, sources={"src0": 4}, permille=900, epochs=1)
