"""Sentences with marked spans, written by hand; SEEN was looked at while the labelled table was widened, UNSEEN only afterwards."""

SEEN = """
Please call {tel:555-123-4567} before noon.
My name is {name:Laura Bennett} and I teach chemistry.
You can reach the front desk by phone {tel:(212) 555 0198} or in person.
Dr. {name:Samuel Okafor} will see you on Monday.
Mrs. {name:Thompson} left her umbrella at the office.
Her passport {national_id:X4829175} was found near the station.
SSN {national_id:123-45-6789} appears on the second page.
The service needs token = "{secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b}" to start.
password: {secret:4e07408562bedb8b60ce05c1decfe3ad} should be changed at once
Fax {tel:020 7946 0991} still works, oddly enough.
Herr {name:Lukas Brandt} wohnt in der Gartenstraße.
Frau {name:Vogel} kommt heute nicht.
Mein DNI: {national_id:12345678Z}, bitte notieren.
El profesor dice que llame al tel: {tel:944 123 456}.
Call me at {tel:617-555-0143}, ask for the manager.
The form lists Name: {name:Priya Raman} and nothing else.
We spoke with Mr. {name:Chen} about the delivery.
Le numéro de mobile {tel:06123 456789} ne répond pas.
apikey={secret:0cc175b9c0f1b6a831c399e269772661} was committed by mistake.
The letter was signed, {name:Oliver Grant}
Prof. {name:Ines Carvalho} reviewed both drafts.
His ssn: {national_id:987-65-4321} must not be printed.
secret = "{secret:5d41402abc4b2a76b9719d911017c5925d414020}"
passport no. {national_id:48291756} expired in May.
For questions contact {name:Marta Lindqvist} or the help desk.
Sra. {name:Elena Quispe} pidió una copia.
phone: {tel:415-555-0176}
The key = "{secret:7c4a8d09ca3762af61e59520943dc26494f8941b}" belongs to staging.
mobile {tel:91234 567890} and nothing more
Monsieur {name:Laurent Dubois} arrive demain matin.
The Apache License, Version 2.0 applies to this file.
In 2019 the town had 48,291 people and 12 schools.
Order 55512345 shipped on 2021-03-14 from New York.
The key idea is that prices fall when supply grows.
We will call the function twice and phone home later.
Chapter 3 covers the French Revolution and Napoleon Bonaparte.
He paid $ 1,299.00 for a used car in South Dakota.
The name of the rose is a novel; the token economy is a theory.
Die Stadt Berlin hat 3.7 Millionen Einwohner.
Commit 3f2a9c1 fixed the build on Tuesday.
Room 204 is open from 9 to 5; the password is shown on the wall.
See pages 12-14 and table 3-2 for the full results.
Les enfants jouent dans le Jardin du Luxembourg.
La Casa Blanca anunció 250 medidas nuevas.
GDP rose 2.4 percent, said the Central Bank.
Version 10.2.1 drops support for old drivers.
A signed copy was sold for 300 euros.
Contact lenses are cheaper in larger packs.
Score: 21-15, 18-21, 21-19 in the final.
The building, 120 metres tall, opened in 1974.
"""

UNSEEN = """
Yesterday Mr. {name:Whitfield} sold his bakery to a cousin.
If in doubt, call {tel:303-555-0119} and leave a message.
The visa office kept passport {national_id:X7741903} for a week.
Set token: {secret:b6d767d2f8ed5d21a44b0e5886680cb9} in the settings file.
Dr. {name:Amara Nwosu} and Prof. {name:Henrik Dahl} wrote the preface.
Reception: phone {tel:(617) 555 0162}, second floor.
ssn: {national_id:219-09-9999}
My name is {name:Tomas Herrera}, I live in Lima.
Ring the mobile {tel:07700 900123} after six.
Frau {name:Schneider} unterrichtet Musik.
password: {secret:ab56b4d92b40713acc5af89985d4b786}
DNI: {national_id:44556677} figura en el contrato.
Mrs. {name:Abernathy} and her dog walked to the pier.
tel: {tel:555-867-5309}, evenings only
Sr. {name:Ramiro Fuentes} firmó el acta.
passport number {national_id:30981745} was cancelled
They talked about the name of the ship and its key features.
Fax machines were common in 1995, call centres in 2005.
Apartment 12, 480 square feet, built 1931, sold for 250,000.
New York and Los Angeles are 2,445 miles apart.
The secret of good bread is time; 24 hours at 4 degrees.
A password manager stores 300 logins on average.
Table 7 lists 1999-2004 figures for Great Britain.
Build 20210314 passed 18 of 20 checks.
"""
