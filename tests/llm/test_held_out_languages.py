"""Everyday sentences and mixed texts that are neither seeds nor sample, with the seeds alone as training."""

import random

from tessera.llm import languages

SENTENCES = {
    "de": """Am Morgen fuhr der Bus nicht, weil Schnee lag.|Meine Schwester hat gestern einen Kuchen gebacken.|Der Vertrag gilt nur bis zum Ende des Jahres.|Auf dem Dach sitzen drei Tauben und warten.|Wer zuerst kommt, bekommt den besten Platz.|Die Rechnung muss innerhalb von zwei Wochen bezahlt werden.|Im Hafen liegen viele kleine Boote.|Er konnte die ganze Nacht nicht schlafen.""",
    "en": """The bus did not run this morning because of the snow.|My sister baked a cake yesterday afternoon.|The contract is valid only until the end of the year.|Three pigeons are sitting on the roof and waiting.|Whoever comes first gets the best seat.|The bill has to be paid within two weeks.|Many small boats lie in the harbour.|He could not sleep all night long.""",
    "fr": """Le bus ne roulait pas ce matin à cause de la neige.|Ma sœur a préparé un gâteau hier après-midi.|Le contrat n'est valable que jusqu'à la fin de l'année.|Trois pigeons attendent sur le toit.|Celui qui arrive le premier obtient la meilleure place.|La facture doit être payée dans les deux semaines.|Beaucoup de petits bateaux sont dans le port.|Il n'a pas pu dormir de toute la nuit.""",
    "es": """El autobús no circuló esta mañana por la nieve.|Mi hermana hizo un pastel ayer por la tarde.|El contrato solo es válido hasta fin de año.|Tres palomas esperan sentadas en el tejado.|Quien llega primero consigue el mejor asiento.|La factura debe pagarse en un plazo de dos semanas.|Hay muchos barcos pequeños en el puerto.|No pudo dormir en toda la noche.""",
    "nl": """De bus reed vanmorgen niet vanwege de sneeuw.|Mijn zus heeft gisteren een taart gebakken.|Het contract geldt alleen tot het einde van het jaar.|Drie duiven zitten op het dak te wachten.|Wie het eerst komt, krijgt de beste plaats.|De rekening moet binnen twee weken worden betaald.|In de haven liggen veel kleine boten.|Hij kon de hele nacht niet slapen.""",
}


def test_single_sentences_and_mixed_texts():
    nearest = languages.Nearest(languages.train([]))
    single = [(code, s) for code, block in SENTENCES.items() for s in block.split("|")]
    assert sum(languages.segments_of(s, nearest)[0][2] == code for code, s in single) >= 0.85 * len(single)
    draw, right = random.Random(4), 0
    for _ in range(200):
        codes = draw.sample(sorted(SENTENCES), 2)
        text = " ".join(s for c in codes for s in draw.sample(SENTENCES[c].split("|"), 4))
        right += [s[2] for s in languages.segments_of(text, nearest)] == codes
    assert right >= 90


def test_a_doubtful_sentence_follows_its_neighbours():
    products = languages.np.array([[1.0, 0.4], [0.9, 1.0], [1.0, 0.3], [0.2, 1.0], [0.3, 1.0]])
    assert languages.steadied(products, products.argmax(1)).tolist() == [0, 0, 0, 1, 1]
